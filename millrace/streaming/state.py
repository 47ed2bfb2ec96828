"""Streams of the engine: replays dropped, windows and sessions with late data, limits and breakers as keyed state.

Each stream has a batch twin that gives the same rows over a finished table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Calls let through in a window, failures that open a breaker, how long both count, and how long it stays open.
CALLS, CALL_WINDOW, FAILURES, FAILURE_WINDOW, OPEN = 20, 60_000, 4, 60_000, 30_000

LIMITED = "key string, at_ms long, accepted boolean"
BROKEN = "key string, at_ms long, state string"


def limit(calls: list[int], times: list[int]) -> tuple[list[int], list[bool]]:
    """Whether each call is let through, and the calls that still count; refused calls don't."""
    out = []
    for at in times:
        calls = [t for t in calls if t > at - CALL_WINDOW]
        ok = len(calls) < CALLS
        if ok:
            calls.append(at)
        out.append(ok)
    return calls, out


def breaker(failures: list[int], since: int, events: list[tuple[int, bool]]) -> tuple[list[int], int, list[str]]:
    """The state that each call finds; a call is only made, and counted, when the breaker isn't open. since: -1 when closed."""
    out = []
    for at, failed in events:
        if since >= 0 and at - since < OPEN:
            out.append("open")
            continue
        out.append("half-open" if since >= 0 else "closed")
        since = -1
        if failed:
            failures = [*(t for t in failures if t >= at - FAILURE_WINDOW), at]
            if len(failures) >= FAILURES:
                since = at
        else:
            failures = []
    return failures, since, out


def _in_order(calls: DataFrame, key: str, columns: list[str], step, first, kind: str) -> DataFrame:
    """Each key's rows in order of time through step(state, rows) -> (state, values), as one sorted stream for each task:
    only the state of the key at hand is held, however many rows it has."""

    def run(batches):
        at, state = None, first()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows = list(zip(*(c.to_pylist() for c in batch.columns[1:])))
            lo, out = 0, []
            while lo < len(keys):
                hi = lo
                while hi < len(keys) and keys[hi] == keys[lo]:
                    hi += 1
                if keys[lo] != at:
                    at, state = keys[lo], first()
                state, values = step(state, rows[lo:hi])
                out += values
                lo = hi
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["key", "at_ms", "value"])

    ordered = calls.repartition("key").sortWithinPartitions("key", *columns)
    return ordered.select("key", *columns).mapInArrow(run, f"key string, at_ms long, value {kind}")


def limited(calls: DataFrame, key: str, at_ms: str) -> DataFrame:
    """(key, at_ms, accepted) of a finished table of calls; each key's calls in order of time."""
    own = calls.select(F.col(key).cast("string").alias("key"), F.col(at_ms).alias("at_ms")).filter("key is not null and at_ms is not null")
    return _in_order(own, "key", ["at_ms"], lambda kept, rows: limit(kept, [r[0] for r in rows]), list, "boolean").withColumnRenamed("value", "accepted")


def _timed(calls: DataFrame, late: str) -> DataFrame:
    """calls with a watermark, which begins at 0; what lies on it would be late, so times count from 1."""
    return calls.withColumn("at", F.timestamp_millis(F.col("at_ms") + 1)).withWatermark("at", late)


def _keep(state: GroupState, value: tuple, last: int, lasts: int) -> None:
    """Keeps a key's state until nothing that may still come can depend on it; then it times out and is forgotten."""
    state.update(value)
    state.setTimeoutTimestamp(max(last + lasts + 1, state.getCurrentWatermarkMs() + 1))


def limited_stream(calls: DataFrame, key: str, at_ms: str, late: str = "1 hour") -> DataFrame:
    """The same for a stream: the accepted calls of the last window are each key's state, as long as they count."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        times = sorted(t for f in frames for t in f["at_ms"].tolist())
        kept, ok = limit(kept, times)
        _keep(state, (kept,), times[-1], CALL_WINDOW)
        yield pd.DataFrame({"key": k[0], "at_ms": times, "accepted": ok})

    own = calls.select(F.col(key).cast("string").alias("key"), F.col(at_ms).alias("at_ms")).filter("key is not null and at_ms is not null")
    return _timed(own, late).groupBy("key").applyInPandasWithState(run, LIMITED, "kept array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def broken(calls: DataFrame, key: str, at_ms: str, failed: str) -> DataFrame:
    """(key, at_ms, state) of a finished table of calls with whether each would fail."""

    def step(state, rows):
        kept, since, out = breaker(*state, rows)
        return (kept, since), out

    own = calls.select(F.col(key).cast("string").alias("key"), F.col(at_ms).alias("at_ms"), F.coalesce(F.col(failed), F.lit(False)).alias("failed"))
    return _in_order(own.filter("key is not null and at_ms is not null"), "key", ["at_ms", "failed"], step, lambda: ([], -1), "string").withColumnRenamed("value", "state")


def broken_stream(calls: DataFrame, key: str, at_ms: str, failed: str, late: str = "1 hour") -> DataFrame:
    """The same for a stream: recent failures and when the breaker opened are each key's state, as long as they count."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept, since = (list(state.get[0]), state.get[1]) if state.exists else ([], -1)
        pdf = pd.concat(list(frames)).sort_values(["at_ms", "failed"])
        times = pdf["at_ms"].tolist()
        kept, since, out = breaker(kept, since, list(zip(times, pdf["failed"].tolist())))
        if since < 0:  # an open breaker stays so until a call finds it half open
            _keep(state, (kept, since), times[-1], FAILURE_WINDOW)
        else:
            state.update((kept, since))
        yield pd.DataFrame({"key": k[0], "at_ms": times, "state": out})

    own = calls.select(F.col(key).cast("string").alias("key"), F.col(at_ms).alias("at_ms"), F.coalesce(F.col(failed), F.lit(False)).alias("failed"))
    return _timed(own.filter("key is not null and at_ms is not null"), late).groupBy("key").applyInPandasWithState(run, BROKEN, "kept array<long>, since long", "append", GroupStateTimeout.EventTimeTimeout)


def first_deliveries(log: DataFrame, key: str, at: str, late: str = "10 days") -> DataFrame:
    """A stream without rows delivered again; what comes later than `late` behind the newest is dropped."""
    return log.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def trend(log: DataFrame, at: str, by: list[str], width: str = "1 day", late: str = "10 days") -> DataFrame:
    """(start, by, n): rows in each window of time; a window closes once it is `late` behind."""
    return log.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(log: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(by, start, end, n): runs of rows without a longer gap."""
    return log.withWatermark(at, late).groupBy(by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
