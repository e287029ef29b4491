"""Calls and the results that consume them, on a stream: keyed state with timers, whatever order rows come in within the watermark."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sessionloom.operators.joins import pair_once

PAIRS = "session_key string, call_id string, call_evt long, call string, result_evt long, result string"


def _paired(expiry_ms: int):
    """One call's rows: those above the watermark wait; those below it are taken in order, so that a later call replaces a pending one and the first result takes it."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, held = json.loads(state.get[0]) if state.exists else (None, [])
        for f in frames:
            held += list(zip(f["ms"].tolist(), f["evt"].tolist(), f["is_call"].tolist(), f["payload"].tolist(), strict=True))
        now = state.getCurrentWatermarkMs()
        held.sort(key=lambda r: (r[1], not r[2]))
        # rows are taken in the order of evt; one that waits holds back those after it
        out, n = [], 0
        while n < len(held) and held[n][0] < now:
            ms, evt, is_call, payload = held[n]
            n += 1
            if is_call:
                pending = [ms, evt, payload]
            elif pending is not None:
                out.append((*key, pending[1], pending[2], evt, payload))
                pending = None
        held = held[n:]
        if pending is not None and pending[0] + expiry_ms < now:
            pending = None
        if held or pending is not None:
            state.update((json.dumps([pending, held]),))
            wake = [r[0] for r in held] + ([pending[0] + expiry_ms] if pending is not None else [])
            state.setTimeoutTimestamp(max(min(wake) + 1, now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PAIRS.split(", ")])

    return run


def pairs(events: DataFrame, late: str = "1 hour", expiry: str = "1 day") -> DataFrame:
    """session_key, call_id, call_evt, call, result_evt, result of rows (session_key, call_id, ts, evt, is_call, payload), evt rising with ts in a session.

    A batch is paired by ``pair_once``.  On a stream, rows wait until the watermark (``late`` behind the newest) has passed them, so any order within it gives the same pairs; rows
    that come later than that are dropped and counted (``late_rows``).  A call that no result has taken is forgotten ``expiry`` after it.
    """
    rows = events.select(F.col("session_key").cast("string").alias("session_key"), F.col("call_id").cast("string").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("evt").cast("long").alias("evt"), "is_call", F.col("payload").cast("string").alias("payload"))
    if not events.isStreaming:
        both = pair_once(rows, F.col("is_call"), ~F.col("is_call"), ["session_key", "call_id"], ["evt"], ["payload"])
        return both.select("session_key", "call_id", F.col("call.evt").alias("call_evt"), F.col("call.payload").alias("call"), F.col("result.evt").alias("result_evt"), F.col("result.payload").alias("result"))
    ms = int(pd.Timedelta(expiry).total_seconds() * 1000)
    timed = rows.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)
    return timed.groupBy("session_key", "call_id").applyInPandasWithState(_paired(ms), PAIRS, "s string", "append", GroupStateTimeout.EventTimeTimeout)


def late_rows(query) -> int:
    """How many rows a query has dropped because they came after the watermark."""
    return sum(o.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for o in p["stateOperators"])
