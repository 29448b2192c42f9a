"""Running moderation of streamed answers: every delta is judged with what came before it, and the first hit ends the answer.

A delta is judged together with the words before it whose normal form has at least `OVERLAP` letters; the words
are whole, so that a rule meets the same word bounds there as in the whole text.  However a text is cut into deltas,
the verdict is that of the rules on the text up to the delta, as long as no match has more than OVERLAP letters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.safety import MODERATION
from .answers import until

OVERLAP, LONGEST = 300, 20_000
_RULES = {category: [re.compile(r) for r in rules] for category, rules in MODERATION.items()}
#: Rules of which every letter is Cyrillic: text without such letters can't match them.
_CYRILLIC = re.compile("[а-яё]")
_RUSSIAN = {r for rules in MODERATION.values() for r in rules if not re.search("[a-z]", re.sub(r"\\.", "", r))}
_JOINS = "\n\r\t‍"
_CONTROLS = {c: None for c in (*range(32), 127) if chr(c) not in _JOINS}
VERDICT = "answer_id long, seq long, sent boolean, rules string"


def form(text: str) -> str:
    """What `functions.safety.for_match` makes of a text."""
    if text.isascii():  # is its own NFKC, and has no hidden characters but controls
        return re.sub(r"\s+", " ", text.translate(_CONTROLS).lower()).strip(" ")
    shown = "".join(c for c in unicodedata.normalize("NFKC", text) if c in _JOINS or unicodedata.category(c) not in ("Cc", "Cf"))
    return re.sub(r"\s+", " ", shown.lower().replace("ё", "е")).strip(" ")


def matched(text: str) -> list[str]:
    """category#number of the first rule that matches, for each category."""
    plain = form(text)
    russian = _CYRILLIC.search(plain)
    first = ((category, next((n for n, rule in enumerate(rules, 1) if (russian or rule.pattern not in _RUSSIAN) and rule.search(plain)), 0)) for category, rules in _RULES.items())
    return [f"{category}#{n}" for category, n in first if n]


def kept(text: str) -> str:
    """The end of a text that the next delta is judged with: whole words of OVERLAP letters, at most LONGEST signs."""
    text, size = text[-LONGEST:], 0
    for start, word in _from_end(text):
        size += (len(word) if word.isascii() and word.isprintable() else len(form(word))) + 1
        if size > OVERLAP:
            return text[start:]
    return text


def _from_end(text: str) -> Iterator[tuple[int, str]]:
    """Place and word of a text's words, last first; only what is asked for is cut."""
    end = len(text)
    while head := text[:end].rstrip():
        start = max(0, len(head) - 4 * OVERLAP)
        words = list(re.finditer(r"\S+", head[start:]))
        if start and not head[start - 1].isspace():  # the first word may begin before the piece
            words = words[1:]
            if not words:
                words = list(re.finditer(r"\S+", head))
                start = 0
        yield from ((start + w.start(), w.group()) for w in reversed(words))
        end = start + words[0].start()


def judged(rows: pd.DataFrame, tail: str, blocked: bool) -> tuple[list[tuple], str, bool]:
    """seq, sent, rules of deltas in order, and the state after them."""
    out = []
    for seq, delta in zip(rows["seq"], rows["delta"].fillna(""), strict=True):
        found = [] if blocked else matched(tail + delta)
        blocked = blocked or bool(found)
        out.append((seq, not blocked, ",".join(found) or None))
        tail = "" if blocked else kept(tail + delta)
    return out, tail, blocked


def moderated(deltas: DataFrame, delay: str = "1 minute", idle: float = 600.0) -> DataFrame:
    """VERDICT of each delta of a stream (answer_id, seq, delta, last, ts): not sent from the first hit on; rules stand at that one only.

    The state is what the next delta is judged with; it ends with the end mark, or when the answer is idle in event time.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tail, blocked, latest = state.get if state.exists else ("", False, 0.0)
        several = list(parts)
        rows = (several[0] if len(several) == 1 else pd.concat(several)).sort_values("seq")
        found, tail, blocked = judged(rows, tail, blocked)
        latest = max(latest, rows["ts"].max().timestamp())
        if not rows["last"].any():
            state.update((tail, blocked, latest))
            until(state, latest, idle)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *x) for x in found], columns=["answer_id", "seq", "sent", "rules"])

    timely = deltas.withWatermark("ts", delay)
    return timely.groupBy("answer_id").applyInPandasWithState(run, VERDICT, "tail string, blocked boolean, latest double", "append", GroupStateTimeout.EventTimeTimeout)


def moderated_batch(deltas: DataFrame) -> DataFrame:
    """VERDICT of finished streams; an answer's deltas are replayed in order by one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found, *_ = judged(rows.sort_values("seq"), "", False)
        return pd.DataFrame([(rows["answer_id"].iloc[0], *x) for x in found], columns=["answer_id", "seq", "sent", "rules"])

    return deltas.select("answer_id", "seq", "delta").groupBy("answer_id").applyInPandas(run, VERDICT)
