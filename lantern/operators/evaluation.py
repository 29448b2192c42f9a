"""Tables of retrieval and answer evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def per_question(retrieved: DataFrame, gold: DataFrame, hit_at: int = 5, at: int = 10) -> DataFrame:
    """question, type, hit, rr, recall: retrieved (question, rank, doc_id) keeps repeats, gold has relevant ids as an array."""
    j = gold.join(retrieved.filter(F.col("rank") <= at), "question", "left")
    relevant = F.array_contains("relevant", F.col("doc_id"))
    first = F.min(F.when(relevant, F.col("rank")))
    found = j.groupBy("question", "type").agg(first.alias("first"), F.count_distinct(F.when(relevant, F.col("doc_id"))).alias("found"), F.first(F.size(F.array_distinct("relevant"))).alias("n"))
    return found.select("question", "type", F.coalesce((F.col("first") <= hit_at).cast("int"), F.lit(0)).alias("hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), (F.col("found") / F.col("n")).alias("recall"))


def means(scores: DataFrame, by: Sequence[str] = (), places: int = 4) -> DataFrame:
    """n, hit, mrr, recall over questions, for each group."""
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), places).alias("hit"), F.round(F.avg("rr"), places).alias("mrr"), F.round(F.avg("recall"), places).alias("recall"))


def distribution(rows: DataFrame, group: str, value: str, places: int = 3) -> DataFrame:
    """group, n, min, p10, median, p90, max of scores."""
    found = _at_places(rows.select(group, value), [group], value, {"p10": lambda n: F.bround(F.lit(0.1) * (n - 1), 0) + 1, "p90": lambda n: F.bround(F.lit(0.9) * (n - 1), 0) + 1})
    r = lambda c: F.round(c, places)
    return found.select(group, "n", r(F.col("lo")).alias("min"), r(F.col("p10")).alias("p10"), r(F.col("median")).alias("median"), r(F.col("p90")).alias("p90"), r(F.col("hi")).alias("max"))


def _at_places(rows: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys, n, lo, hi, median and the values at places (from 1, by the number n) among each group's values in order, null ones left out.

    Values are counted first; a window over the counts finds the places, so a group's rows are never one row or one array.
    The median lies between the two middle places.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    whole = Window.partitionBy(*keys)
    running = whole.orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumns({"__upto": F.sum("__c").over(running), "n": F.sum("__c").over(whole)})
    at = {**places, "__low": lambda n: F.floor((n + 1) / 2), "__high": lambda n: F.floor(n / 2) + 1}
    first = lambda place: F.min(F.when(F.col("__upto") >= F.greatest(place(F.col("n")), F.lit(1)), F.col("__v")))
    found = placed.groupBy(*keys).agg(F.first("n").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"), *(first(p).alias(name) for name, p in at.items()))
    return found.withColumn("median", (F.col("__low") + F.col("__high")) / 2).drop("__low", "__high")


def threshold(rows: DataFrame, score: str = "score", inside: str = "inside", places: int = 3) -> DataFrame:
    """One row: threshold, errors.  The middle of the gap where a threshold separates inside from outside; else the score
    (or 0.01 above one from outside) with the fewest errors, the lower one in a tie.

    Counts for all candidates come from one sorted pass over distinct scores, not from candidates times scores.
    """
    s = rows.select(F.round(score, places).alias("s"), F.col(inside).alias("i"))
    counts = s.groupBy("s").agg(F.count_if("i").alias("ins"), F.count_if(~F.col("i")).alias("outs"))
    candidates = counts.filter("ins > 0").select(F.col("s").alias("t")).union(counts.filter("outs > 0").select(F.round(F.col("s") + 0.01, places))).distinct()
    events = counts.select("s", "ins", "outs", F.lit(1).alias("kind")).union(candidates.select("t", F.lit(0), F.lit(0), F.lit(0)))
    below = Window.orderBy("s", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # rows: distinct rounded scores
    totals = counts.agg(F.sum("outs").alias("all_outs"), F.min(F.when(F.col("ins") > 0, F.col("s"))).alias("low"), F.max(F.when(F.col("outs") > 0, F.col("s"))).alias("high"))
    run = events.withColumns({"missed": F.sum("ins").over(below), "kept_out": F.sum("outs").over(below)}).filter("kind = 0").crossJoin(totals)
    best = run.withColumn("errors", F.col("missed") + F.col("all_outs") - F.col("kept_out")).agg(F.min(F.struct("errors", "s")).alias("b"), F.first("low").alias("low"), F.first("high").alias("high"))
    apart = F.col("low") > F.col("high")
    return best.select(F.when(apart, F.round((F.col("low") + F.col("high")) / 2, places)).otherwise(F.col("b.s")).alias("threshold"), F.when(apart, F.lit(0).cast("long")).otherwise(F.col("b.errors")).alias("errors"))


def gates(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """metric, value, passed for each limit (metric, least, most); a metric that is missing or NaN fails."""
    value = F.when(F.isnan("value"), None).otherwise(F.col("value"))
    ok = (value >= F.coalesce("least", F.lit(float("-inf")))) & (value <= F.coalesce("most", F.lit(float("inf"))))
    return limits.join(metrics, "metric", "left").select("metric", value.alias("value"), F.coalesce(ok, F.lit(False)).alias("passed"))


def summary(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """metric, mean, n, nan: failed scores (NaN) are counted but leave the mean."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("x")).select("x.*")
    good = F.when(~F.isnan("v"), F.col("v"))
    return long.groupBy("metric").agg(F.round(F.avg(good), 4).alias("mean"), F.count(good).alias("n"), F.count_if(F.isnan("v")).alias("nan"))


def run_totals(rows: DataFrame) -> DataFrame:
    """One row of a run's rows (response, latency_ms, confident, contexts, errors): rows, latency mean, p50 and p95 in whole milliseconds,
    refusals by the score guard (without contexts) and by the model, empty answers, rows with errors.

    Percentiles interpolate; an empty answer is a failure and no refusal.
    """
    answered = F.coalesce(F.col("response"), F.lit("")) != ""
    refused = answered & ~F.coalesce(F.col("confident"), F.lit(False))
    guard = refused & (F.coalesce(F.size("contexts"), F.lit(0)) <= 0)
    ms = lambda c: F.bround(c, 0).cast("long")
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), ms(F.avg("latency_ms")).alias("latency_mean"), ms(F.expr("percentile(latency_ms, 0.5)")).alias("latency_p50"), ms(F.expr("percentile(latency_ms, 0.95)")).alias("latency_p95"),
        F.count_if(guard).alias("refused_guard"), F.count_if(refused & ~guard).alias("refused_model"), F.count_if(~answered).alias("empty"), F.count_if(F.coalesce(F.size("errors"), F.lit(0)) > 0).alias("with_errors"),
    )


#: Measures of an agent's run beside its latency.
TOKENS = ("prompt_tokens", "completion_tokens", "total_tokens", "steps", "llm_calls")


def agent_benchmark(runs: DataFrame) -> DataFrame:
    """task, impl, runs, latency (mean, least, most), means of TOKENS, correct, forced stops and errors that weren't forced stops."""
    mean = lambda c: F.bround(F.avg(c), 1).alias(c)
    forced = F.coalesce(F.col("forced"), F.lit(False))
    return runs.groupBy("task", "impl").agg(
        F.count(F.lit(1)).alias("runs"), F.bround(F.avg("latency_ms"), 0).alias("latency_ms"), F.bround(F.min("latency_ms"), 0).alias("latency_min"), F.bround(F.max("latency_ms"), 0).alias("latency_max"),
        *map(mean, TOKENS), F.count_if("correct").alias("correct"), F.count_if(forced).alias("forced"), F.count_if(F.col("error").isNotNull() & ~forced).alias("errors"),
    )


def benchmark_totals(benchmark: DataFrame) -> DataFrame:
    """impl, and the sums of its tasks' means and counts (`agent_benchmark`)."""
    return benchmark.groupBy("impl").agg(*(F.round(F.sum(c), 1).alias(c) for c in ("latency_ms", "prompt_tokens", "completion_tokens", "total_tokens", "llm_calls")), F.sum("correct").alias("correct"), F.sum("runs").alias("runs"))


def inventory(files: DataFrame) -> DataFrame:
    """category, files, bytes, formats (a map of each to its files), authors (distinct, in order) of files (category, format, bytes, author)."""
    by_format = files.groupBy("category", "format").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.collect_set("author").alias("authors"))
    formats = F.map_from_entries(F.filter(F.collect_list(F.struct("format", "n")), lambda x: x["format"].isNotNull()))
    return by_format.groupBy("category").agg(F.sum("n").alias("files"), F.sum("bytes").alias("bytes"), formats.alias("formats"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("authors")))).alias("authors"))


def worst(rows: DataFrame, metric: str, key: str, n: int) -> DataFrame:
    """The n rows of the smallest metric, ties by key, NaN and null left out."""
    return rows.filter(F.col(metric).isNotNull() & ~F.isnan(metric)).orderBy(metric, key).limit(n)


def diagnosis(retrieval: Column, generation: Column, low: float = 0.5) -> Column:
    return F.when((retrieval < low) & (generation < low), "both").when(retrieval < low, "retrieval").when(generation < low, "generation").otherwise("neither")


def keyword_recall(answer: Column, groups: Column) -> Column:
    """Share of keyword groups ("a|b": either) that the answer holds, 3 places; null without groups."""
    missing = F.size(F.filter(groups, lambda g: ~F.exists(F.split(g, r"\|"), lambda v: F.contains(answer, F.trim(v)))))
    return F.when(F.size(groups) > 0, F.round(1 - missing / F.size(groups), 3))


def forbidden(answer: Column, listed: Column) -> Column:
    return F.filter(listed, lambda w: F.contains(answer, w))


def deltas(runs: DataFrame, base: str) -> DataFrame:
    """run, metric, value, delta against the base run (runs: run, metric, value)."""
    b = runs.filter(F.col("run") == base).select("metric", F.col("value").alias("base"))
    return runs.join(b, "metric", "left").select("run", "metric", F.round("value", 4).alias("value"), F.round(F.col("value") - F.col("base"), 4).alias("delta"))


def latest(runs: DataFrame, label: str, at: str) -> DataFrame:
    """The latest row of each label; a partial aggregate."""
    return runs.groupBy(label).agg(F.max_by(F.struct(*runs.columns), F.struct(at, *[c for c in runs.columns if c != at])).alias("r")).select("r.*")


def attack_success(attempts: DataFrame) -> DataFrame:
    """probe, detector, attempts, evaluated, hits (from 0.5 on), nulls of attempts of status 2 (results: map of detector to scores)."""
    each = attempts.filter("status = 2").select("probe", F.explode("results").alias("detector", "scores")).select("probe", "detector", F.explode_outer("scores").alias("score"))
    return each.groupBy("probe", "detector").agg(F.count(F.lit(1)).alias("attempts"), F.count("score").alias("evaluated"), F.count_if(F.col("score") >= 0.5).alias("hits"), F.count_if(F.col("score").isNull()).alias("nulls"))


def cost(usage: DataFrame, prices: Mapping[str, float], label: str) -> DataFrame:
    """label, cost of each label's usage, and of all (label null): every price is for a column of the usage."""
    total = sum((F.sum(F.col(c)) * p for c, p in prices.items()), F.lit(0.0))
    return usage.rollup(label).agg(*(F.sum(c).alias(c) for c in prices), F.round(total, 4).alias("cost"))


def latency_table(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and nearest-rank p95 for each of the keys, and for the first key alone (others null)."""
    p95 = {"p95": lambda n: F.ceil(F.lit(0.95) * n)}
    out = None
    for level in range(len(keys), 0, -1):
        found = _at_places(rows.select(*keys[:level], value), list(keys[:level]), value, p95)
        part = found.select(*keys[:level], *(F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys[level:]), F.round("median", 4).alias("median"), F.round("p95", 4).alias("p95"))
        out = part if out is None else out.unionByName(part)
    return out


def round_robin(rows: DataFrame, category: str, key: str, seed: str, n: int, skip: DataFrame | None = None) -> DataFrame:
    """The first n rows, taking one of each category in turn; inside a category in the order of a seeded hash."""
    left = rows if skip is None else rows.join(skip.select(key), key, "left_anti")
    order = Window.partitionBy(category).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))))
    return left.withColumn("turn", F.row_number().over(order)).orderBy("turn", category).limit(n)


def lexical(questions: DataFrame, articles: DataFrame, terms_of, least: int = 2, top: int = 3, most_questions: int = 200_000) -> DataFrame:
    """question_id, rank, id, score: distinct stems shared with title (3), keywords (2) and text (1); ties to the smaller id.

    Questions come in groups of about most_questions, each broadcast as an index from stems to questions; a task finds
    what its articles score and keeps `top` rows a question, and only those are shuffled: stems of any frequency stay
    where the articles are.  Stems of both sides are made once and kept for all groups.  The articles with the most stems
    say first what a question's last kept row scores at least, so that most sums needn't be finished (`_scored`).
    Rows of one question_id are one question.
    """
    asked = questions.repartition("question_id").groupBy("question_id").agg(F.array_distinct(F.flatten(F.collect_list(terms_of(F.col("question"))))).alias("stems"))
    fields = articles.select("id", *(terms_of(F.col(c)).alias(c) for c in ("title", "keywords", "text"))).persist(StorageLevel.DISK_ONLY)
    asked = _with_floor(asked, fields, least, top)
    if (n := questions.count()) > most_questions:  # several groups read both
        asked = asked.persist(StorageLevel.DISK_ONLY)
        n = asked.count()
    groups, out = max(1, -(-n // most_questions)), None
    for g in range(groups):
        found = _scored(fields, asked.filter(F.pmod(F.xxhash64("question_id"), F.lit(groups)) == g), least, top)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("question_id", "rank", "id", "score")


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, one after another, and where each row's begin; a null list is empty."""
    lists = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, [])
    return lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()


def _with_floor(asked: DataFrame, fields: DataFrame, least: int, top: int, most_seeds: int = 512, most_cells: int = 100_000_000) -> DataFrame:
    """asked (question_id, stems) with floor: the top-th score among the articles with the most stems, so no row below it is kept."""
    size = sum((F.coalesce(F.size(c), F.lit(0)) for c in ("title", "keywords", "text")), F.lit(0))
    seeds = fields.orderBy(size.desc(), "id").limit(most_seeds).select("title", "keywords", "text").toArrow()  # a bounded number of rows
    found = [_lists(seeds[c]) for c in ("title", "keywords", "text")]
    stems = pa.chunked_array([v for v, _ in found]).unique()
    n = min(len(seeds), most_cells // max(1, len(stems)))
    weights = np.zeros((len(stems), n), np.uint8)
    for w, (values, at) in zip((3, 2, 1), found, strict=True):
        values, at = values[: at[n]], at[: n + 1]
        weights[pc.index_in(values, stems).to_numpy(zero_copy_only=False), np.repeat(np.arange(n), np.diff(at))] += np.uint8(w)
    shared = fields.sparkSession.sparkContext.broadcast((stems, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems, weights = shared.value
        for batch in batches:
            values, at = _lists(batch.column(1))
            code, floor = pc.fill_null(pc.index_in(values, stems), -1).to_numpy(), np.full(batch.num_rows, least, np.int64)
            if weights.shape[1] >= top:
                for i in range(batch.num_rows):
                    own = code[at[i] : at[i + 1]]
                    score = weights[own[own >= 0]].sum(0, dtype=np.int64)
                    floor[i] = max(least, np.partition(score, -top)[-top])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], names=["question_id", "stems", "floor"])

    return asked.mapInArrow(run, f"question_id {asked.schema['question_id'].dataType.simpleString()}, stems array<string>, floor long")


def _scored(fields: DataFrame, asked: DataFrame, least: int, top: int, most_cells: int = 100_000_000, most_hits: int = 500_000) -> DataFrame:
    """question_id, id, score: the best articles of each task for each question of a group, as far as they can be kept.

    A stem that many questions of the group have is a row of bits over all of them, and a bit of each of them; the others
    are lists of questions.  The bits have at most most_cells bytes.  An article's sum is first made of the
    lists, and of the rows for what title and keywords add to the text's one.  Where it is too small even if the text has
    all of the question's other stems, the article isn't kept; for the questions left, shared bits are counted.
    """
    rows = asked.toArrow().combine_chunks()  # a group of questions, of bounded size
    values, begin = _lists(rows["stems"])
    coded, length = values.dictionary_encode(), np.diff(begin)
    code, asking = coded.indices.to_numpy(), np.repeat(np.arange(len(length), dtype=np.int32), length)
    first = np.searchsorted(np.sort(code), np.arange(len(coded.dictionary) + 1))
    longest, kind = length.max(initial=0), asked.schema["question_id"].dataType
    index = (coded.dictionary, first, asking[np.argsort(code, kind="stable")], rows["question_id"].combine_chunks(), rows["floor"].to_numpy())
    shared = fields.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems, first, of_stem, names, floor = shared.value
        n, size = len(names), np.diff(first)
        often = np.flatnonzero(size * 100 > n)
        often = often[np.argsort(-size[often], kind="stable")][: min(1024, 4 * most_cells // max(1, n))]
        place = np.full(len(size), -1, np.int64)
        place[often] = np.arange(len(often))
        ones, most = np.zeros(n, np.uint8), -(-len(often) // 64) * 64
        row, own = np.zeros((most, -(-n // 8)), np.uint8), np.zeros((n, most // 8), np.uint8)
        for i, s in enumerate(often.tolist()):
            ones[:] = 0
            ones[of_stem[first[s] : first[s + 1]]] = 1
            row[i] = np.packbits(ones)
        for i in range(most // 8):
            own[:, i] = np.packbits(np.unpackbits(row[8 * i : 8 * i + 8], 1, n), 0)[0]
        bits = own.view(np.uint64)
        lists = np.split(of_stem, first[1:-1])
        wide = np.uint16 if longest * 6 < 65_536 else np.uint32
        open_, third = np.bitwise_count(bits).sum(1, dtype=np.int64), floor.copy()
        # sums, and what they need beside all stems that have rows: bytes for articles of few stems
        narrow, whole = ((np.zeros(n, t), np.zeros(n, t)) for t in (np.uint8, wide))
        enough = np.zeros(-(-n // 8) * 8, bool)
        eights, eight = enough.reshape(-1, 8), np.arange(8)
        best, hits, waiting = np.empty((3, 0), np.int64), [], 0  # question, score, id

        def needed() -> None:
            for _, need in (narrow, whole):
                need[:] = np.clip(third - open_, 0, np.iinfo(need.dtype).max)

        def merged() -> None:
            nonlocal best, hits, waiting
            best = np.concatenate((best, *hits), 1)
            best = best[:, np.lexsort((best[2], -best[1], best[0]))]
            at = np.arange(best.shape[1]) - np.searchsorted(best[0], best[0])
            best, at = best[:, at < top], at[at < top]
            last = at == top - 1
            third[best[0][last]] = np.maximum(best[1][last], third[best[0][last]])
            needed()
            hits, waiting = [], 0

        def kept(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            """The questions that may keep an article of these stems (of title, keywords, text), and its scores."""
            placed = [place[f] for f in found]
            few = [f[p < 0].tolist() for f, p in zip(found, placed, strict=True)]
            sums, need = narrow if 3 * len(found[0]) + 2 * len(found[1]) + len(few[2]) < 256 else whole
            sums[:] = 0
            if some := [lists[s] for s in few[0] * 3 + few[1] * 2 + few[2]]:
                np.add.at(sums, np.concatenate(some, dtype=np.intp), sums.dtype.type(1))
            for w, p in zip((3, 2), placed, strict=False):
                some = p[p >= 0].tolist()
                for lo in range(0, len(some), 255 // w):
                    ones[:] = 0
                    for i in some[lo : lo + 255 // w]:
                        np.add(ones, np.unpackbits(row[i], count=n), out=ones)
                    np.multiply(ones, np.uint8(w), out=ones)
                    np.add(sums, ones, out=sums)
            np.greater_equal(sums, need, out=enough[:n])
            at = np.flatnonzero(enough.view(np.uint64))  # eight questions at a time
            hit = (at[:, None] * 8 + eight)[eights[at]]
            held = np.zeros(most, np.uint8)
            held[placed[2][placed[2] >= 0]] = 1
            score = sums[hit].astype(np.int64)
            if most:
                score += np.bitwise_count(bits[hit] & np.packbits(held).view(np.uint64)).sum(1, dtype=np.int64)
            fine = score >= third[hit]
            return hit[fine], score[fine]

        needed()
        for batch in batches:
            columns, lo = [_lists(c) for c in batch.columns[1:]], 0
            while lo < batch.num_rows:  # about a million stems of texts at a time
                at = columns[2][1]
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + 1_000_000, "right")) - 1)
                ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                part = [(pc.fill_null(pc.index_in(v.slice(at[lo], at[hi] - at[lo]), stems), -1).to_numpy(), at[lo : hi + 1] - at[lo]) for v, at in columns]
                for k, id in enumerate(ids):
                    found = [code[at[k] : at[k + 1]] for code, at in part]
                    found = [f[f >= 0] for f in found]
                    if not any(map(len, found)):
                        continue
                    hit, score = kept(found)
                    if len(hit):
                        hits.append(np.stack((hit, score, np.full(len(hit), id, np.int64))))
                        waiting += len(hit)
                    if waiting > most_hits:
                        merged()
                lo = hi
        merged()
        yield pa.RecordBatch.from_arrays([names.take(pa.array(best[0])), pa.array(best[2]), pa.array(best[1])], names=["question_id", "id", "score"])

    return fields.select(F.col("id").cast("long").alias("id"), "title", "keywords", "text").mapInArrow(run, f"question_id {kind.simpleString()}, id long, score long")


def attributed(contexts: DataFrame, docs: DataFrame, most_contexts: int = 2_000, most_bytes: int = 1 << 20, plain: bool = False) -> DataFrame:
    """context_id, doc_id where the document's text holds the context's or the context's text holds the document's.

    Lines of a context that only mark a hop (`<1-hop>`) aren't part of it; an empty context or text holds nothing and is held by none.
    plain: contexts are taken as they are, and an empty context or text is held by every text, as by SQL's contains.  Up to
    a checked number and size the contexts go to every task, and documents are read once without a shuffle; more of
    them meet the documents on runs of words.
    """
    lines = F.filter(F.split("context", r"\r\n|[\n\r]"), lambda x: ~(F.startswith(x, F.lit("<")) & F.endswith(x, F.lit("-hop>"))))
    own = F.col("context") if plain else F.regexp_replace(F.array_join(lines, "\n"), r"(?U)^\s+|\s+$", "")
    c = contexts.select("context_id", own.alias("context")).filter("context IS NOT NULL" if plain else "context <> ''").distinct()
    d = docs.select("doc_id", "text").filter("text IS NOT NULL" if plain else "text <> ''")
    n, size = c.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("context").cast("long")), F.lit(0))).first()
    if n <= most_contexts and size <= most_bytes:
        known = sorted((tuple(r) for r in c.collect()), key=str)
        shared = docs.sparkSession.sparkContext.broadcast([(i, x, len(x)) for i, x in known])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc, context = [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    own = len(text)
                    for i, x, length in shared.value:
                        if (x in text) if length <= own else (text in x):
                            doc.append(k)
                            context.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(context, ids), batch.column(0).take(pa.array(doc, pa.int64()))], names=["context_id", "doc_id"])

        ids = to_arrow_type(c.schema["context_id"].dataType)
        schema = f"context_id {c.schema['context_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}"
        return d.mapInArrow(run, schema).distinct()
    d = d.distinct()
    inner = _held(c.select(F.col("context_id").alias("a"), F.col("context").alias("needle")), d.select(F.col("doc_id").alias("b"), F.col("text").alias("hay")))
    outer = _held(d.select(F.col("doc_id").alias("a"), F.col("text").alias("needle")), c.select(F.col("context_id").alias("b"), F.col("context").alias("hay")))
    found = inner.select(F.col("a").alias("context_id"), F.col("b").alias("doc_id")).unionByName(outer.select(F.col("b").alias("context_id"), F.col("a").alias("doc_id")))
    if plain:  # empty ones share no run with anything
        pairs = c.filter("context = ''").select("context_id").crossJoin(d.select("doc_id")).unionByName(c.select("context_id").crossJoin(d.filter("text = ''").select("doc_id")))
        found = found.unionByName(pairs)
    return found.distinct()


def _held(needles: DataFrame, hays: DataFrame, most: int = 4, probe: int = 16) -> DataFrame:
    """a, b where hay b holds needle a.

    The words of a needle between its first and its last stand whole in what holds it, so the two meet on a run of up
    to `most` of these.  A needle of fewer than three words meets on its first `probe` characters, or on all of them;
    only where there are such needles are runs of characters made.  What met is compared whole.
    """
    words = lambda c: F.split(c, r"\s+")
    run = lambda w, i, n: F.xxhash64(F.array_join(F.slice(w, i, n), " "))
    shape = needles.withColumn("w", words(F.col("needle"))).withColumn("inner", F.least(F.size("w") - 2, F.lit(most)))
    # size: a number of words, or the negative of a number of characters
    size = F.when(F.col("inner") > 0, F.col("inner")).otherwise(-F.least(F.char_length("needle"), F.lit(probe)))
    k = F.when(F.col("inner") > 0, run(F.col("w"), F.lit(2), F.greatest("inner", F.lit(1)))).otherwise(F.xxhash64(F.substring("needle", 1, probe)))
    n = shape.select("a", size.alias("size"), k.alias("k"))
    sizes = n.agg(F.collect_set("size").alias("sizes"))  # one row of at most most + probe numbers
    places = lambda w, width: F.when(F.size(w) >= width, F.sequence(F.lit(1), F.size(w) - width + 1))
    of_words = F.transform(places(F.col("w"), F.col("size")), lambda i: run(F.col("w"), i, F.col("size")))
    of_signs = F.transform(places(F.col("w"), -F.col("size")), lambda i: F.xxhash64(F.array_join(F.slice("w", i, -F.col("size")), "")))
    each = hays.crossJoin(F.broadcast(sizes)).select("b", "hay", F.explode("sizes").alias("size"))
    split = each.withColumn("w", F.when(F.col("size") > 0, words(F.col("hay"))).otherwise(F.split("hay", "")))
    runs = split.select("b", "size", F.explode(F.array_distinct(F.when(F.col("size") > 0, of_words).otherwise(of_signs))).alias("k"))
    met = runs.join(n, ["k", "size"]).select("a", "b").distinct()
    return met.join(needles, "a").join(hays, "b").filter(F.contains("hay", F.col("needle"))).select("a", "b").distinct()


def best_overlap(answers: DataFrame, chunks: DataFrame, least: float = 0.3) -> DataFrame:
    """answer_id, number: the chunk (numbered in an answer's context) with the largest share of the answer's terms."""
    a = answers.select("answer_id", F.explode("terms").alias("term"), F.size("terms").alias("n"))
    c = chunks.select("answer_id", "number", F.explode("terms").alias("term")).distinct()
    shares = a.join(c, ["answer_id", "term"]).groupBy("answer_id", "number").agg((F.count(F.lit(1)) / F.first("n")).alias("share"))
    return shares.groupBy("answer_id").agg(F.max_by("number", F.struct("share", -F.col("number"))).alias("number"), F.max("share").alias("share")).filter(F.col("share") >= least).select("answer_id", "number")


def last_beneath(spans: DataFrame, top_kind: str, kind: str) -> DataFrame:
    """trace_id, top, last: under each span of top_kind, the span of `kind` that starts last (null: none).

    Each span keeps one ancestor and the best span found between the two; a round doubles the distance, so a trace of
    any depth takes as many rounds as its depth has binary digits, each over one row for a span.  A cycle ends once the
    distance covers the largest trace; a span in it is beneath itself.
    """
    own = F.when((F.col("span_kind") == kind) & F.col("start_time").isNotNull(), F.struct("start_time", "span_id"))
    nodes = spans.filter("span_id IS NOT NULL").select("trace_id", "span_id", F.col("parent_id").alias("up"), own.alias("own"))
    below = nodes.filter("up IS NOT NULL").groupBy("trace_id", F.col("up").alias("span_id")).agg(F.max("own").alias("best"))
    state = _cut(nodes.drop("own").distinct().join(below, ["trace_id", "span_id"], "left"))
    most, reach = state.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 0, 1
    while reach < most and not state.filter("up IS NOT NULL").isEmpty():
        more = state.filter("up IS NOT NULL AND best IS NOT NULL").groupBy("trace_id", F.col("up").alias("span_id")).agg(F.max("best").alias("more"))
        jump = state.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("further")).distinct()
        wider = state.join(more, ["trace_id", "span_id"], "left").join(jump, ["trace_id", "up"], "left")
        state = _cut(wider.select("trace_id", "span_id", F.col("further").alias("up"), F.greatest("best", "more").alias("best")).distinct())
        reach *= 2
    found = state.groupBy("trace_id", F.col("span_id").alias("top")).agg(F.max("best").alias("best"))
    tops = spans.filter(F.col("span_kind") == top_kind).select("trace_id", F.col("span_id").alias("top"))
    return tops.join(found, ["trace_id", "top"], "left").select("trace_id", "top", F.col("best.span_id").alias("last"))


def _cut(df: DataFrame) -> DataFrame:
    """df with a short lineage, in the folder of spark.checkpoint.dir; kept in memory and on disk where none is set."""
    context, folder = df.sparkSession.sparkContext, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder and context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint() if context.getCheckpointDir() else df.persist(StorageLevel.MEMORY_AND_DISK)


def reviewed(raw: DataFrame, decisions: DataFrame) -> DataFrame:
    """id, question, state, edited: raw rows after review (decisions: id, keep, reason, question).

    state: kept, dropped, no decision, no reason (dropped without one), unknown (a decision without a row).
    """
    j = raw.select("id", F.col("question").alias("old")).withColumn("raw", F.lit(True)).join(decisions.withColumn("decided", F.lit(True)), "id", "full_outer")
    state = F.when(F.col("raw").isNull(), "unknown").when(F.col("keep").isNull(), "no decision").when(F.col("keep"), "kept").when(F.coalesce(F.trim("reason"), F.lit("")) == "", "no reason").otherwise("dropped")
    edited = F.col("raw").isNotNull() & F.col("question").isNotNull() & ~F.col("question").eqNullSafe(F.col("old"))
    return j.select("id", F.coalesce("question", "old").alias("question"), state.alias("state"), edited.alias("edited"))


def snapshot_diff(old: DataFrame, new: DataFrame, failed: DataFrame, full: bool = True) -> DataFrame:
    """file, state: new, changed, unchanged, failed or removed (only on a full run), from snapshots (file, doc_id, hash).

    Files are compared by a hash of their documents' ids and hashes; texts aren't read.
    """
    of = lambda d, name: d.groupBy("file").agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("doc_id", "hash")))).alias(name))
    j = of(old, "a").join(of(new, "b"), "file", "full_outer").join(failed.select("file", F.lit(True).alias("f")), "file", "full_outer")
    gone = F.lit("removed") if full else F.lit(None)
    state = F.when(F.col("f"), "failed").when(F.col("a").isNull(), "new").when(F.col("b").isNull(), gone).when(F.col("a") == F.col("b"), "unchanged").otherwise("changed")
    return j.select("file", state.alias("state")).filter("state IS NOT NULL")
