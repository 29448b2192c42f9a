"""License scan: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them.

DataFrame functions only.  A text's words (runs of letters and digits, in lower case) give hashes of all runs of
five.  For templates of up to s shingles, windows of 2 s shingles start every s shingles, so that any occurrence lies
in one window whole.  Each window and each template have `BANDS` MinHash values, every one a band of its own.  A window
that holds four fifths of a template of n shingles has a Jaccard similarity of at least `least_similarity(n)` with it:
0.125 for a template of one shingle, 0.19 or more from three on; it shares a band with a probability of `found(n)`, over
0.9998 for any n.  Equal bands are joined with the templates' (a broadcast table of fixed size), and the share of the
template's shingles in the window decides.

A band is only equal where the window holds the template's shingle that made it, so bands are only made for windows
that hold some shingle of a template; this spares work and loses no match.

Defined results: null, empty and very short texts match nothing; rows of one id count as one document; a template
shorter than five words is one shingle of all its words and can't be matched inside texts, so there is none; other
columns aren't looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS, BANDS, LEAST = 5, 64, 0.8

#: Wordings of public licenses' notices.
NOTICES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "MIT-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def size_class(shingles: int) -> int:
    """Windows of the class hold twice so many shingles."""
    return max(4, 1 << (shingles - 1).bit_length())


def least_similarity(shingles: int) -> float:
    """Of a template and a window that holds four fifths of it."""
    held = math.ceil(LEAST * shingles)
    return held / (2 * size_class(shingles) + shingles - held)


def found(shingles: int) -> float:
    """The probability that such a window shares a band with the template."""
    return 1 - (1 - least_similarity(shingles)) ** BANDS


def _let(value: Column, body) -> Column:
    """body of the value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _shingles(text: Column) -> Column:
    """Hashes of all runs of five words, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    none = F.array().cast("array<bigint>")

    def runs(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WORDS))))

    return _let(words, lambda w: F.when(F.size(w) >= WORDS, runs(w)).otherwise(none))


def _bands(shingles: Column) -> Column:
    """BANDS values, each the smallest of the shingles under another hash; the band's number is mixed in."""

    def least(i: int) -> Column:
        return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(i))))

    return F.array(*(F.xxhash64(F.lit(i), least(i)) for i in range(BANDS)))


def templates(spark: SparkSession, notices: dict[str, str]) -> DataFrame:
    """license, size (class of shingles: a power of two), shingles, bands; a row for each notice."""
    rows = spark.createDataFrame(sorted(notices.items()), "license string, notice string")
    sized = rows.select("license", F.array_distinct(_shingles(F.col("notice"))).alias("shingles")).filter(F.size("shingles") > 0)
    size = F.pow(F.lit(2.0), F.greatest(F.lit(2.0), F.ceil(F.log2(F.size("shingles").cast("double"))))).cast("int")
    return sized.select("license", size.alias("size"), "shingles", _bands(F.col("shingles")).alias("bands"))


def scanned(df: DataFrame, notices: dict[str, str] = NOTICES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, license, containment (share of the notice's shingles, at least 0.8), n_windows, first_shingle."""
    spark = df.sparkSession
    known = templates(spark, notices)
    listed = known.select("size", "shingles").collect()  # of fixed size: the notices
    some = sorted({h for r in listed for h in r["shingles"]})
    sizes = sorted({r["size"] for r in listed})

    def windows(h: Column) -> Column:
        """The windows, of each class, that hold a shingle of any notice."""
        hits = F.filter(F.transform(h, lambda x, i: F.when(x.isin(some), i)), lambda i: i.isNotNull())

        def of_class(p: Column, s: int) -> Column:
            starts = F.array_distinct(F.flatten(F.transform(p, lambda i: F.array(i - i % s, i - i % s - s))))
            return F.transform(F.filter(starts, lambda a: a >= 0), lambda a: F.struct(F.lit(s).alias("s"), a.alias("at"), F.array_distinct(F.slice(h, a + 1, 2 * s)).alias("win")))

        return _let(hits, lambda p: F.concat(*(of_class(p, s) for s in sizes)))

    found = df.select(F.col(key).alias("__key"), F.explode(_let(_shingles(F.col(text)), windows)).alias("__x"))
    cut = found.select("__key", F.col("__x.s").alias("__s"), F.col("__x.at").alias("__at"), F.col("__x.win").alias("__win"))
    banded = cut.withColumn("__band", F.explode(_bands(F.col("__win"))))
    retrieved = banded.join(F.broadcast(known.select("license", F.col("size").alias("__s"), "shingles", F.explode("bands").alias("__band"))), ["__s", "__band"])
    share = F.size(F.array_intersect("shingles", "__win")) / F.size("shingles")
    matched = retrieved.withColumn("containment", share).filter(F.col("containment") >= LEAST)
    return matched.groupBy(F.col("__key").alias(key), "license").agg(
        F.max("containment").alias("containment"), F.count_distinct("__at").alias("n_windows"), F.min("__at").cast("long").alias("first_shingle")
    )
