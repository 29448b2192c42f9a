"""Incremental ingest: a stream of corpus files keeps documents, chunks and vectors up to date.

Every batch is a version: what changed of the documents, the chunks of these, a report by file, and last its commit.
Nothing of a version counts before its commit is there, and a version that is committed is left alone, so a batch
that fails anywhere and is run again gives what one clean run gives.  A batch only touches the files it brings: unchanged
documents aren't chunked or embedded, and old versions aren't rewritten.  The snapshot is each document's last
committed row with the chunks of that version; `compacted` rewrites it as one version when there are many.

Defined results: a file that comes twice in a batch counts as it came last; a file that can't be read (error) is failed and its
documents go; documents that a file no longer has go; a document of which the model fails on a chunk is pending with
its text, its old chunks go, and it is tried again with every batch; a document without text is kept without
chunks.  A stream doesn't know what a full listing lacks: `removed` takes one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import chunking
from ..sources import corpus

NODES = "0f6f9f2c-4f0e-5d0a-9a53-8d5d6a3b7c11"
DOCS = "file string, doc_id string, hash string, status string, error string, text string"
POINTS = "id string, doc_id string, number int, text string, tokens long, vector array<float>, error string"
REPORT = "file string, state string, documents long, pending long, error string"
STEP = 1000  # between the versions of two batches, for what is done between them


@dataclass(frozen=True)
class Ingest:
    folder: str
    embed: Callable[[list[str]], np.ndarray]
    model: str = "model"
    how: str = "recursive"
    size: int = 512
    overlap: int = 64
    batch: int = 128

    @property
    def label(self) -> str:
        """What documents were made with; another label makes every document a changed one."""
        return f"{self.model} {self.how}:{self.size}/{self.overlap}"


def corpus_files(spark: SparkSession, root: str, most_files: int = 1000) -> DataFrame:
    """A stream of file, doc_id, text, error, at from files in root/<delivery>/<file>; deliveries sort by name."""
    raw = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", most_files).load(root)
    path = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    inside = re.escape(re.sub(r"^[a-z]+:/*", "/", root.rstrip("/"))) + r"/([^/]+)/(.+)$"
    file, suffix = F.regexp_extract(path, inside, 2), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    page = corpus.page("value")
    text = F.when(suffix.isin("html", "htm"), page["text"]).otherwise(texts.clean(F.col("value")))
    error = F.when(~suffix.isin("md", "txt", "html", "htm"), F.concat(F.lit("unsupported: "), suffix)).when(F.coalesce(F.trim(text), F.lit("")) == "", "no text")
    return raw.select(file.alias("file"), file.alias("doc_id"), text.alias("text"), error.alias("error"), F.regexp_extract(path, inside, 1).alias("at"))


def _read(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, v long").parquet(f"{folder}/{name}")


def _write(df: DataFrame, folder: str, name: str, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}/v={version}")


def opened(spark: SparkSession, folder: str) -> None:
    """Lays out an empty version 0 where the folder has none."""
    try:
        spark.read.schema("whole boolean, v long").parquet(f"{folder}/commits").isEmpty()
    except AnalysisException:
        for name, schema in (("docs", DOCS), ("points", POINTS), ("report", REPORT)):
            _write(spark.createDataFrame([], schema), folder, name, 0)
        _write(spark.createDataFrame([(True,)], "whole boolean"), folder, "commits", 0)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Committed versions since the last whole one: a number for each batch since then."""
    rows = spark.read.schema("whole boolean, v long").parquet(f"{folder}/commits").collect()
    first = max((r["v"] for r in rows if r["whole"]), default=0)
    return sorted(r["v"] for r in rows if r["v"] >= first)


def _committed(spark: SparkSession, folder: str, name: str, schema: str, upto: int | None = None) -> DataFrame:
    some = [v for v in versions(spark, folder) if upto is None or v < upto]
    return _read(spark, folder, name, schema).filter(F.col("v").isin(some))  # prunes the folders of the other versions


def documents(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    """DOCS and v: each document's last committed row, before version upto; documents that went are left out."""
    rows = _committed(spark, folder, "docs", DOCS, upto)
    last = F.max_by(F.struct(*rows.columns), "v")
    return rows.groupBy("doc_id").agg(last.alias("r")).select("r.*").filter("status <> 'gone'")


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """POINTS (without error) and file: the chunks of all live documents."""
    live = documents(spark, folder).filter("status = 'live'").select("file", "doc_id", "v")
    return _committed(spark, folder, "points", POINTS).join(live, ["doc_id", "v"]).select("file", "id", "doc_id", "number", "text", "tokens", "vector")


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """REPORT and v of every committed batch since the last whole version."""
    return _committed(spark, folder, "report", REPORT)


def _embedded(chunks: DataFrame, job: Ingest) -> DataFrame:
    """chunks (doc_id, number, text, tokens, key) with vector, error; texts of a batch that fails are tried one by one.

    Equal keys come one after another, so that each distinct text goes through the model once and texts move once.
    """
    embed, size = job.embed, job.batch

    def one(text: str) -> tuple[np.ndarray | None, str | None]:
        try:
            return np.asarray(embed([text]), np.float32)[0], None
        except Exception as e:  # what a model throws is unknown; the document becomes pending
            return None, f"{type(e).__name__}: {e}"[:300]

    def several(content: list[str]) -> list[tuple[np.ndarray | None, str | None]]:
        try:
            return [(v, None) for v in np.asarray(embed(content), np.float32)]
        except Exception:
            return [one(t) for t in content]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}  # the last key
        for batch in batches:
            keys = batch.column(4).to_pylist()
            first = {k: i for i, k in reversed(list(enumerate(keys))) if k not in known}
            fresh = sorted(first, key=first.get)
            for lo in range(0, len(fresh), size):
                some = fresh[lo : lo + size]
                known |= zip(some, several(batch.column(2).take(pa.array([first[k] for k in some])).to_pylist()), strict=True)
            found = [known[k] for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([v for v, _ in found], pa.list_(pa.float32())), pa.array([e for _, e in found], pa.string())], names=[*batch.schema.names[:4], "vector", "error"])
            known = {k: known[k] for k in keys[-1:]} or known

    ordered = chunks.select("doc_id", "number", "text", "tokens", "key").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "doc_id string, number int, text string, tokens long, vector array<float>, error string")


def ingested(incoming: DataFrame, job: Ingest, version: int) -> None:
    """One batch of file, doc_id, text, error, at as a version; nothing where that is committed."""
    spark = incoming.sparkSession
    opened(spark, job.folder)
    if version in versions(spark, job.folder):
        return
    came = incoming.withColumn("text", F.coalesce("text", F.lit(""))).persist()
    try:
        hashed = F.sha2(F.concat_ws("\x1f", F.lit(job.label), "file", "text"), 256)
        # what came without its text, which the hash names: only texts of new and changed documents move
        rows = came.select("file", "doc_id", "at", "error", hashed.alias("hash"))
        last = rows.groupBy("file").agg(F.max("at").alias("at"))
        came_last = rows.join(last, ["file", "at"]).groupBy("file", "doc_id").agg(F.max("error").alias("error"), F.min("hash").alias("hash"))
        failed = came_last.filter("error IS NOT NULL").groupBy("file").agg(F.max("error").alias("file_error"))
        known = documents(spark, job.folder, version)
        again = known.filter("status = 'pending'").join(last, "file", "left_anti").select("file", "doc_id", "text").withColumn("hash", hashed)
        current = came_last.join(failed, "file", "left_anti").select("file", "doc_id", "hash").unionByName(again.drop("text"))
        texts_of = came.select("file", "doc_id", "text").withColumn("hash", hashed).unionByName(again)
        touched = last.select("file").unionByName(again.select("file")).distinct()
        old = known.join(touched, "file", "left_semi").select(F.col("file").alias("old_file"), "doc_id", F.col("hash").alias("old_hash"), (F.col("status") == "live").alias("live"))
        both = current.join(old, "doc_id", "full_outer").withColumn("same", F.coalesce(F.col("live") & (F.col("hash") == F.col("old_hash")), F.lit(False)))
        # 1. chunks of new and changed documents, each text through the model once
        named = ["file", "doc_id", "hash"]
        fresh = texts_of.join(both.filter("file IS NOT NULL AND NOT same").select(*named), named, "left_semi").dropDuplicates(named).select("doc_id", "text")
        chunks = chunking.chunked(fresh, job.size, job.overlap, job.how).withColumn("key", F.sha2("text", 256))
        node = texts.uuid5(NODES, F.concat("doc_id", F.lit("#"), F.col("number").cast("string")))
        points = _embedded(chunks, job).select(node.alias("id"), "doc_id", "number", "text", "tokens", "vector", "error")
        _write(points, job.folder, "points", version)
        # 2. documents: live, pending where a chunk has no vector, gone
        bad = _read(spark, job.folder, "points", POINTS).filter((F.col("v") == version) & F.col("vector").isNull()).groupBy("doc_id").agg(F.max(F.coalesce("error", F.lit("no vector"))).alias("error"))
        changed = both.filter("NOT same").join(bad, "doc_id", "left")
        status = F.when(F.col("file").isNull(), "gone").when(F.col("error").isNotNull(), "pending").otherwise("live")
        docs = changed.select(F.coalesce("file", "old_file").alias("file"), "doc_id", "hash", status.alias("status"), "error")
        if bad.isEmpty():
            docs = docs.withColumn("text", F.lit(None).cast("string"))
        else:
            kept = texts_of.join(bad, "doc_id", "left_semi").dropDuplicates(named)
            docs = docs.join(kept, named, "left").withColumn("text", F.when(F.col("status") == "pending", F.col("text"))).select("file", "doc_id", "hash", "status", "error", "text")
        _write(docs, job.folder, "docs", version)
        # 3. the report, and the commit
        pending = _read(spark, job.folder, "docs", DOCS).filter((F.col("v") == version) & (F.col("status") == "pending")).groupBy("file").agg(F.count(F.lit(1)).alias("pending"))
        of_file = both.groupBy(F.coalesce("file", "old_file").alias("file")).agg(
            F.count("file").alias("documents"), F.coalesce(F.bool_and("same"), F.lit(True)).alias("all_same"), F.count("old_hash").alias("before"), F.count_if(F.col("live")).alias("live")
        )
        state = F.when(F.col("file_error").isNotNull(), "failed").when(F.coalesce("before", F.lit(0)) == 0, "new").when(F.col("all_same"), "unchanged").when(F.col("live") == 0, "retried").otherwise("changed")
        report = touched.join(of_file, "file", "left").join(failed, "file", "left").join(pending, "file", "left")
        _write(report.select("file", state.alias("state"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("pending", F.lit(0)).alias("pending"), F.col("file_error").alias("error")), job.folder, "report", version)
        _write(spark.createDataFrame([(False,)], "whole boolean").coalesce(1), job.folder, "commits", version)
    finally:
        came.unpersist()


def ingest(stream: DataFrame, job: Ingest):
    """The writer of a stream of file, doc_id, text, error, at; its checkpoint lies in the job's folder, as its batches number the versions."""
    return stream.writeStream.foreachBatch(lambda batch, n: ingested(batch, job, (n + 1) * STEP)).option("checkpointLocation", f"{job.folder}/stream")


def removed(spark: SparkSession, job: Ingest, listing: DataFrame) -> None:
    """A version in which the documents of files that a full listing (file) lacks are gone."""
    opened(spark, job.folder)
    version = versions(spark, job.folder)[-1] + 1
    gone = documents(spark, job.folder).join(listing.select("file"), "file", "left_anti")
    null = F.lit(None).cast("string")
    _write(gone.select("file", "doc_id", null.alias("hash"), F.lit("gone").alias("status"), null.alias("error"), null.alias("text")), job.folder, "docs", version)
    _write(spark.createDataFrame([], POINTS), job.folder, "points", version)
    report = gone.groupBy("file").agg(F.lit("removed").alias("state"), F.count(F.lit(1)).alias("documents"), F.lit(0).cast("long").alias("pending"), null.alias("error"))
    _write(report, job.folder, "report", version)
    _write(spark.createDataFrame([(False,)], "whole boolean").coalesce(1), job.folder, "commits", version)


def compacted(spark: SparkSession, job: Ingest) -> None:
    """The snapshot as one whole version; readers need no older one after its commit."""
    version = versions(spark, job.folder)[-1] + 1
    _write(snapshot(spark, job.folder).withColumn("error", F.lit(None).cast("string")).drop("file"), job.folder, "points", version)
    _write(documents(spark, job.folder).drop("v"), job.folder, "docs", version)
    _write(spark.createDataFrame([], REPORT), job.folder, "report", version)
    _write(spark.createDataFrame([(True,)], "whole boolean").coalesce(1), job.folder, "commits", version)
