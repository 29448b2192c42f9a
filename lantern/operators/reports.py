"""Report tables over answer runs: judged answers, groups that overlap, implementations, prompts, pairs, reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts


def judged_answers(items: DataFrame) -> DataFrame:
    """One row: mean and least correctness, keyword recall, violations, errors (items: correctness, keyword_recall, violations, error)."""
    return items.agg(
        F.round(F.avg("correctness"), 2).alias("mean"), F.min("correctness").alias("least"), F.round(F.avg("keyword_recall"), 3).alias("keyword_recall"),
        F.count_if(F.col("violations") > 0).alias("violations"), F.count("error").alias("errors"),
    )


def shares_by_group(rows: DataFrame, groups: Sequence[tuple[str, Column]], flag: str) -> DataFrame:
    """group, n, share of the flag for groups that may overlap."""
    named = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in groups)))
    return rows.select(F.explode(named).alias("group"), flag).groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(flag).cast("double")), 4).alias("share"))


def free_checks(rows: DataFrame, at: int = 5) -> DataFrame:
    """One row: hit and mean reciprocal rank of the reference file among the first files, answers with a marker.

    rows: files json (array of names, in rank order), reference, answer.
    """
    files = F.slice(F.from_json("files", "array<string>"), 1, at)
    place = F.array_position(files, F.col("reference"))
    return rows.select(place.alias("p"), F.col("answer").rlike(r"\[\d{1,2}").alias("marked")).agg(
        F.round(F.avg((F.col("p") > 0).cast("double")), 4).alias("hit"), F.round(F.avg(F.when(F.col("p") > 0, 1.0 / F.col("p")).otherwise(0.0)), 4).alias("mrr"), F.round(F.avg(F.col("marked").cast("double")), 4).alias("marked")
    )


def implementations(runs: DataFrame, measures: Sequence[str]) -> DataFrame:
    """implementation, the mean and median of each measure, and the models met."""
    each = [f(m) for m in measures for f in (lambda m: F.round(F.avg(m), 4).alias(f"{m}_mean"), lambda m: F.round(F.expr(f"percentile({m}, 0.5)"), 4).alias(f"{m}_p50"))]
    return runs.groupBy("implementation").agg(*each, F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))


def prompt_variants(rows: DataFrame) -> DataFrame:
    """variant, answered and cited shares in the base, refused near it, mean seconds of what the guard let pass."""
    when = lambda c, v: F.round(F.avg(F.when(c, F.col(v).cast("double"))), 4)
    return rows.groupBy("variant").agg(when(F.col("inside"), "answered").alias("answered"), when(F.col("inside"), "cited").alias("cited"), F.round(1 - F.avg(F.when(~F.col("inside"), F.col("answered").cast("double"))), 4).alias("refused"), when(~F.col("guarded"), "seconds").alias("seconds"))


def pair_benchmark(scores: DataFrame) -> DataFrame:
    """One row: pairs, pair accuracy, mean margin, hit@1, hit@3, MRR (scores: query, doc, score, kind relevant, irrelevant or other);
    a document's rank is one more than the number of strictly better ones."""
    ranked = scores.withColumn("rank", F.rank().over(Window.partitionBy("query").orderBy(F.desc("score"))))
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    q = ranked.groupBy("query").agg(of("relevant", "score").alias("r"), of("irrelevant", "score").alias("i"), F.min(F.when(F.col("kind") == "relevant", F.col("rank"))).alias("rank"))
    mean = lambda c: F.round(F.avg(c), 4)
    return q.filter("r IS NOT NULL AND i IS NOT NULL").agg(
        F.count(F.lit(1)).alias("pairs"), mean((F.col("r") > F.col("i")).cast("double")).alias("accuracy"), mean(F.col("r") - F.col("i")).alias("margin"),
        mean((F.col("rank") <= 1).cast("double")).alias("hit1"), mean((F.col("rank") <= 3).cast("double")).alias("hit3"), mean(1.0 / F.col("rank")).alias("mrr"),
    )


def reranked(candidates: DataFrame, cache: DataFrame, model: str, score: Callable[[list[tuple[str, str]]], np.ndarray], top: int) -> DataFrame:
    """question, rank, position, score, cached: candidates (question, position, query, text) by score, then position.

    Only distinct pairs that the cache (key, score) lacks are scored.
    """
    keyed = candidates.withColumn("key", F.sha2(F.concat_ws("\x1f", F.lit(model), "query", "text"), 256))
    missing = keyed.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.first("query").alias("query"), F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(score(pairs), np.float64))], names=["key", "score"])

    fresh = missing.select("key", "query", "text").mapInArrow(run, "key string, score double").withColumn("cached", F.lit(False))
    scored = keyed.join(cache.select("key", "score").withColumn("cached", F.lit(True)).unionByName(fresh), "key")
    order = Window.partitionBy("question").orderBy(F.desc("score"), "position")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("question", "rank", "position", "score", "cached")


def source_list(fragments: DataFrame, answers: DataFrame, snippet: int = 200) -> DataFrame:
    """question, id, file_name, source, category, page, score, snippet, cited of the fragments of each question's context.

    A fragment's number in the context is its id; it is cited where the question's answer names it ([2], [1, 3]).  A missing
    score is 0; a question without an answer cites nothing.
    """
    cited = F.coalesce(F.array_contains(texts.cited(F.col("answer"), F.col("number").cast("int")), F.col("number").cast("int")), F.lit(False))
    short = F.substring(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ")), 1, snippet)
    j = fragments.join(answers.select("question", "answer"), "question", "left")
    return j.select("question", F.col("number").alias("id"), "file_name", "source", "category", "page", F.round(F.coalesce("score", F.lit(0.0)), 3).alias("score"), short.alias("snippet"), cited.alias("cited"))
