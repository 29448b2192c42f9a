"""Release of streamed answers: what is sent is masked, and never cut where masking could still change it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.texts import PII

HOLD, LONGEST = 80, 1000
_PATTERNS = {label: re.compile(pattern) for label, pattern in PII.items()}
_NUMBER_END = re.compile(r"[\d+(][\d\s()+\-]*$")


def masked(text: str) -> str:
    for label, pattern in _PATTERNS.items():
        text = pattern.sub(f"[{label}]", text)
    return text


def released(tail: str, hold: int = HOLD) -> tuple[str, str]:
    """What can be sent of the text so far (masked), and what is held back.

    The cut is the last space that leaves at least `hold` characters, and not inside a number written with spaces; a
    word that grows beyond `LONGEST` characters is sent as it is.
    """
    cut = max((m.end() for m in re.finditer(r"\s", tail[: max(0, len(tail) - hold)])), default=0)
    while cut:
        number = _NUMBER_END.search(tail, 0, cut)
        if not number:
            break
        before = [m.end() for m in re.finditer(r"\s", tail[: number.start()])]
        cut = before[-1] if before else 0
    if not cut and len(tail) > LONGEST:
        cut = len(tail) - hold
    return masked(tail[:cut]), tail[cut:]


def until(state: GroupState, latest: float, idle: float) -> None:
    """The state ends when the watermark is `idle` seconds past the key's latest row."""
    state.setTimeoutTimestamp(max(int((latest + idle) * 1000), state.getCurrentWatermarkMs() + 1))


def guarded(deltas: DataFrame, hold: int = HOLD, delay: str = "1 minute", idle: float = 600.0) -> DataFrame:
    """answer_id, text released by each batch of a stream of (answer_id, seq, delta, last, ts).

    The end mark flushes; so does the end of an answer that got none and was idle for so long in event time.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, latest = state.get if state.exists else ("", 0.0)
        if state.hasTimedOut:
            out, ended = masked(tail), True
        else:
            rows = pd.concat(list(parts)).sort_values("seq")
            tail, ended = tail + "".join(rows["delta"].fillna("")), bool(rows["last"].any())
            latest = max(latest, rows["ts"].max().timestamp())
            out, tail = (masked(tail), "") if ended else released(tail, hold)
        if ended:
            state.remove()
        else:
            state.update((tail, latest))
            until(state, latest, idle)
        yield pd.DataFrame({"answer_id": [key[0]], "text": [out]})

    timely = deltas.withWatermark("ts", delay)
    return timely.groupBy("answer_id").applyInPandasWithState(run, "answer_id long, text string", "tail string, latest double", "append", GroupStateTimeout.EventTimeTimeout)


def guarded_batch(deltas: DataFrame, hold: int = HOLD) -> DataFrame:
    """answer_id, parts: a finished stream replayed delta by delta; an answer's deltas are replayed in order by one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tail, parts = "", []
        for delta in rows.sort_values("seq")["delta"].fillna(""):
            out, tail = released(tail + delta, hold)
            parts += [out] if out else []
        return pd.DataFrame({"answer_id": [rows["answer_id"].iloc[0]], "parts": [[*parts, masked(tail)]]})

    return deltas.groupBy("answer_id").applyInPandas(run, "answer_id long, parts array<string>")
