"""Streams over messages, requests and votes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_votes(votes: DataFrame, delay: str = "7 days") -> DataFrame:
    """A stream of votes without those that follow an owner's first on a message, within the delay."""
    return votes.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["owner", "message_id"])


def rolling_counts(messages: DataFrame, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """start, messages, asked, users (distinct owners who asked) for each window of event time; works on tables too.

    Counts are made by owner first and then added up, so that users are counted exactly and the state has a row for each
    owner and open window.  A window comes out once the watermark is past its end; what is later than that is dropped.
    """
    timely = messages.withWatermark("created_at", delay)
    by_owner = timely.groupBy(F.window("created_at", width).alias("w"), "owner").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "user").alias("asked"))
    counts = by_owner.groupBy(F.window(F.window_time("w"), width).alias("w")).agg(F.sum("n").alias("messages"), F.sum("asked").alias("asked"), F.count_if(F.col("asked") > 0).alias("users"))
    return counts.select(F.col("w.start").alias("start"), "messages", "asked", "users")


def _replay(times: list[float], state: tuple[float, int] | None, limit: int, seconds: float) -> tuple[list[tuple], tuple[float, int] | None]:
    """Verdicts on requests in order, and the state (opening time, count) after them."""
    opened, n = state or (float("-inf"), 0)
    out = []
    for t in times:
        if t >= opened + seconds:
            opened, n = t, 0
        n += 1
        out.append((n <= limit, max(limit - n, 0), 0.0 if n <= limit else opened + seconds - t))
    return out, (opened, n)


VERDICT = "client string, ts timestamp, allowed boolean, remaining int, retry_after double"


def rate_limited_batch(requests: DataFrame, limit: int, seconds: float = 60.0) -> DataFrame:
    """client, ts, allowed, remaining, retry_after: a window opens with a client's first request.  A client's requests are
    replayed in order, which only one task can do; just their times are shuffled, and a task keeps the window of one client."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            clients, out = batch.column(0).to_pylist(), []
            times = [t / 1e6 for t in batch.column(1).cast(pa.int64()).to_pylist()]
            lo = 0
            for hi in range(1, len(clients) + 1):
                if hi == len(clients) or clients[hi] != clients[lo]:
                    found, state = _replay(times[lo:hi], state if clients[lo] == last else None, limit, seconds)
                    out += found
                    last, lo = clients[lo], hi
            allowed, remaining, after = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed, pa.bool_()), pa.array(remaining, pa.int32()), pa.array(after, pa.float64())], names=["client", "ts", "allowed", "remaining", "retry_after"])

    narrow = requests.select(F.col("client").cast("string").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    return narrow.repartition("client").sortWithinPartitions("client", "ts").mapInArrow(run, VERDICT)


def rate_limited(requests: DataFrame, limit: int, seconds: float = 60.0, delay: str = "10 seconds", buckets: int = 4096) -> DataFrame:
    """The stream's twin: the state of a client is its window, dropped when the watermark is past its end.

    All of it is event time: a backlog or a slow batch forgets no window.  Requests later than the delay get no verdict.
    Clients share so many rows of state, by a hash, as a call of Python for each client would take longer than its replay.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts), ignore_index=True)
        rows = rows.assign(**{"null": rows["client"].isna(), "name": rows["client"].fillna("")}).sort_values(["null", "name", "ts"], kind="stable", ignore_index=True)
        windows = {c: (opened, n) for c, opened, n in zip(*state.get, strict=True)} if state.exists else {}
        clients, times = [None if null else c for null, c in zip(rows["null"], rows["name"], strict=True)], [t.timestamp() for t in rows["ts"]]
        out, lo = [], 0
        for hi in range(1, len(clients) + 1):
            if hi == len(clients) or clients[hi] != clients[lo]:
                found, windows[clients[lo]] = _replay(times[lo:hi], windows.get(clients[lo]), limit, seconds)
                out += found
                lo = hi
        ends = {c: int((opened + seconds) * 1000) for c, (opened, _) in windows.items()}
        still = {c: windows[c] for c, end in ends.items() if end > state.getCurrentWatermarkMs()}
        if still:
            state.update((list(still), [o for o, _ in still.values()], [n for _, n in still.values()]))
            state.setTimeoutTimestamp(max(ends[c] for c in still))
        elif state.exists:
            state.remove()
        yield rows[["client", "ts"]].join(pd.DataFrame(out, columns=["allowed", "remaining", "retry_after"]))

    timely = requests.select("client", "ts", F.pmod(F.xxhash64("client"), F.lit(buckets)).alias("bucket")).withWatermark("ts", delay)
    return timely.groupBy("bucket").applyInPandasWithState(run, VERDICT, "clients array<string>, opened array<double>, n array<int>", "append", GroupStateTimeout.EventTimeTimeout)


def to_sinks(screened: DataFrame, allowed: Callable[[DataFrame], None], incidents: Callable[[DataFrame], None]):
    """A stream writer whose every batch goes to two sinks: allowed messages, and incidents without their text."""

    def write(batch: DataFrame, _: int) -> None:
        batch.persist()
        allowed(batch.filter("allowed").select("id", "masked"))
        incidents(batch.filter("NOT allowed").select("id", "categories", "rule", "text_hash"))
        batch.unpersist()

    return screened.writeStream.foreachBatch(write)
