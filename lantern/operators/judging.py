"""Judged answers: rules settle what needs no judge, and the judge sees each distinct question of the rest once.

A judge is a function of a metric and a list of inputs (dicts); it returns a score, or a score and a reason, for each.  What it
throws on one input, and what it leaves open, is a NaN with its reason for that input only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts

METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall", "has_citation")
#: Why a metric has no score from the judge.
EMPTY, NO_CONTEXT, NO_REFERENCE, NOTHING_FOUND, NO_VALUE = "пустой ответ", "нет фрагментов: отказ score-guard", "нет reference", "ничего не найдено: отказ score-guard", "нет значения: "
NAN = "судья вернул NaN"
INPUT = "question string, response string, contexts array<string>, reference string"
Judge = Callable[[str, list[dict]], list]


def _ruled() -> dict[str, tuple]:
    """For each metric the score and the reason that need no judge (null reason: the judge decides), from `empty`, `no_reference`, `contexts`."""
    none, nan = F.lit(None).cast("string"), F.lit(float("nan"))
    empty, no_reference = F.col("empty"), F.col("no_reference")
    bare = F.coalesce(F.size("contexts"), F.lit(0)) <= 0
    of_context = (F.when(~empty & ~no_reference & bare, F.lit(0.0)).otherwise(nan), F.when(empty, EMPTY).when(no_reference, NO_REFERENCE).when(bare, NOTHING_FOUND).otherwise(none))
    plain = (nan, F.when(empty, EMPTY).otherwise(none))
    return {"faithfulness": (nan, F.when(empty, EMPTY).when(bare, NO_CONTEXT).otherwise(none)), "answer_relevancy": plain, "context_precision": of_context, "context_recall": of_context, "has_citation": plain}


def _inputs() -> dict[str, list[str]]:
    return {
        "faithfulness": ["question", "plain", "contexts"], "answer_relevancy": ["question", "plain"], "context_precision": ["question", "reference", "contexts"],
        "context_recall": ["question", "reference", "contexts"], "has_citation": ["response"],
    }


def _score(found) -> tuple[float, str | None]:
    value, reason = found if isinstance(found, tuple) else (found, "")
    if value is None:
        return math.nan, (NO_VALUE + " ".join(str(reason or "").split())[:300]).strip()
    if isinstance(value, str):
        value = 1.0 if value.strip().lower() == "yes" else 0.0
    return (float(value), None) if not math.isnan(value) else (math.nan, NAN)


def judged(rows: DataFrame, judge: Judge, batch: int = 32) -> DataFrame:
    """id, metric, score, error of rows (id, question, response, contexts, reference): a row for each metric.

    Null ids and repeated rows are rows like others; equal inputs are judged once and the score goes to all their rows.
    """
    blank = lambda c: ~F.coalesce(F.col(c).rlike(r"(?U)\S"), F.lit(False))
    digest = lambda c: F.sha2(F.col(c), 256)
    own = F.regexp_replace(texts.without_citations(F.col("response")), "^$", "")
    known = rows.select("id", *(F.col(c).cast("string").alias(c) for c in ("question", "response", "reference")), F.col("contexts").cast("array<string>").alias("contexts"))
    known = known.withColumns({"plain": F.coalesce(F.nullif(own, F.lit("")), F.col("response")), "empty": blank("response"), "no_reference": blank("reference")})
    # texts stand for themselves as digests: keys, rules and scores move without them
    small = known.withColumns({"of_plain": digest("plain"), "of_response": digest("response"), "of_contexts": F.sha2(F.to_json("contexts"), 256)})
    ruled, inputs = _ruled(), _inputs()
    stands = {"question": "question", "plain": "of_plain", "response": "of_response", "contexts": "of_contexts", "reference": "reference"}
    key_of = lambda *parts: F.unhex(F.sha2(F.to_json(F.struct(*parts)), 256))
    row = key_of("question", "of_response", "of_contexts", "reference")
    each = [F.struct(F.lit(m).alias("metric"), ruled[m][0].alias("score"), ruled[m][1].alias("error"), F.when(ruled[m][1].isNull(), key_of(F.lit(m).alias("metric"), *(stands[c] for c in inputs[m]))).alias("key")) for m in METRICS]
    keyed = small.select("id", row.alias("row"), F.explode(F.array(*each)).alias("m")).select("id", "row", "m.*")
    # each distinct input is asked by one of the rows that have it, and the texts of a row move once for all that it asks
    first = keyed.filter("key IS NOT NULL").groupBy("key", "metric").agg(F.min("row").alias("row"))
    asks = first.groupBy("row").agg(F.collect_list(F.struct("metric", "key")).alias("asks"))
    whole = small.filter("NOT empty").select(row.alias("row"), F.struct("question", "response", "contexts", "reference", "plain").alias("x")).groupBy("row").agg(F.first("x").alias("x"))

    def one(metric: str, x: dict) -> tuple[float, str | None]:
        try:
            return _score(judge(metric, [x])[0])
        except Exception as e:  # whatever a judge throws
            return math.nan, f"{type(e).__name__}: {' '.join(str(e).split())[:300]}"

    def several(metric: str, xs: list[dict]) -> list[tuple[float, str | None]]:
        try:
            found = judge(metric, xs)
            if len(found) == len(xs):
                return [_score(f) for f in found]
        except Exception:
            pass
        return [one(metric, x) for x in xs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            waiting: dict[str, list[tuple[bytes, dict]]] = {m: [] for m in METRICS}
            for x, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for w in wanted:
                    given = {"response" if c == "plain" else c: x[c] for c in inputs[w["metric"]] if x[c] is not None}
                    waiting[w["metric"]].append((w["key"], given))
            for m, some in waiting.items():
                out = [f for lo in range(0, len(some), batch) for f in several(m, [x for _, x in some[lo : lo + batch]])]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.binary()), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], pa.string())], names=["key", "judged", "why"])

    found = whole.join(asks, "row").select("x", "asks").mapInArrow(run, "key binary, judged double, why string")
    # a row without a key has one of its own that no input has: null keys would all meet in one task
    at = keyed.withColumn("own", F.col("key").isNull()).withColumn("key", F.coalesce("key", F.concat(F.lit(b"\0"), "row")))
    return at.join(found, "key", "left").select("id", "metric", F.when(F.col("own"), F.col("score")).otherwise(F.col("judged")).alias("score"), F.coalesce("error", "why").alias("error"))
