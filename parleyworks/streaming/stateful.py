"""Streaming forms of sessions, compaction, ticks and the circuit breaker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.telemetry import breaker_step


def session_counts(events: DataFrame, key: str, ts: str, gap: int = 86_400_000_000, late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of each session once the watermark has closed it; ``gap`` microseconds or more begin a new one.

    A session window merges an event at exactly its gap, so it is opened a microsecond short; ``end`` is the last event's time plus that.
    """
    short = gap - 1
    s = F.session_window(ts, f"{short // 1_000_000} seconds {short % 1_000_000} microseconds")
    out = events.withWatermark(ts, late).groupBy(key, s.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def compaction(events: DataFrame, key: str, order: str, text: str, at: int = 15, keep: int = 5, ts: str | None = None, ttl: int = 86_400_000_000, late: str = "1 hour") -> DataFrame:
    """(key, batch, text, n): the rows that each compaction takes, joined in order, when a key's log has reached ``at`` rows.

    The state of a key is its live rows, ``at`` at most; rows of a micro-batch go in ``order``. With ``ts`` a log dies ``ttl``
    microseconds after its last row: a later row begins a new one, whose batches count from 0, and once the watermark has passed that time the
    key's state is gone. Then there is also ``since``, the time of the log's first row.
    """
    kind = events.schema[key].dataType.simpleString()
    columns = [key, order, text, *([ts] if ts else [])]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done, live, since, last = state.get if state.exists else (0, [], None, None)
        live, out = list(live), []
        rows = pd.concat(list(batches)).sort_values([*([ts] if ts else []), order], kind="stable")
        times = [None] * len(rows) if ts is None else [t.value // 1000 for t in rows[ts]]
        for row, now in zip(rows[text], times, strict=True):
            if ts and (last is None or now - last >= ttl):
                done, live, since = 0, [], now
            last = now
            live.append(row)
            if len(live) >= at:
                taken, live = live[: len(live) - keep], live[len(live) - keep :]
                out.append((k[0], done, "\n".join(x or "" for x in taken), len(taken), since))
                done += 1
        state.update((done, live, since, last))
        if ts:
            state.setTimeoutTimestamp(max(last + ttl, state.getCurrentWatermarkMs() * 1000 + 1000) // 1000 + 1)
        yield pd.DataFrame(out, columns=[key, "batch", "text", "n", "since"])

    if ts:
        events = events.where(F.col(ts).isNotNull()).withWatermark(ts, late)
    timeout = GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout
    made = events.select(columns).groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, batch long, text string, n long, since long", "done long, live array<string>, since long, last long", "append", timeout
    )
    return made.withColumn("since", F.timestamp_micros("since")) if ts else made.drop("since")


def ticks(events: DataFrame, key: str, ts: str, value: str, every: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """(tick, key, n, mean): what a collector that runs at a fixed interval would see."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("tick"), key, "n", "mean")


def circuit_breaker(events: DataFrame, key: str, at: str, ok: str, threshold: int = 5, recovery: int = 60_000_000) -> DataFrame:
    """(key, at, outcome) of each call, the state of each key kept between batches; calls of a batch go in time order; calls without a time or an outcome are left out."""
    step = breaker_step(threshold, recovery)
    events = events.where(F.col(at).isNotNull() & F.col(ok).isNotNull())
    kind = events.schema[key].dataType.simpleString()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0, None, False)
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        said = []
        for row in zip(rows[at], rows[ok], strict=True):
            now, word = step(tuple(now), row)
            said.append(word)
        state.update(now)
        yield pd.DataFrame({key: k[0], at: rows[at], "outcome": said})

    return events.select(key, at, ok).groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, {at} long, outcome string", "fails int, opened long, half boolean", "append", GroupStateTimeout.NoTimeout
    )
