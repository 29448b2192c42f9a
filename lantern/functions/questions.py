"""The form of a question under which repeated questions are counted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The punctuation and the white space that a question is counted without.
PUNCTUATION = r"""[.,!?;:«»"'()\[\]{}…—–-]+"""
SPACES = "[ \t\n\r\f\u000b   -​    　﻿]+"


def normalized_question(text: Column) -> Column:
    """Lower case, punctuation and runs of white space as one space, no space at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), PUNCTUATION, " "), SPACES, " "))
