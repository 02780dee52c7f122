"""Streaming forms of ingestion: typed events, dead letters, deduplication, windows, debounce, incremental sync."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT_TYPES = ["signup", "error", "click", "view", "purchase"]


def event_items(events: DataFrame) -> DataFrame:
    """(id, text, memory_type, confidence, at) of typed events: one item each, named by the event."""
    return events.where(F.col("event_type").isin(*EVENT_TYPES)).select(
        F.concat(F.lit("stream-"), F.col("event_id").cast("string")).alias("id"), F.coalesce("props", F.lit("")).alias("text"), F.col("event_type").alias("memory_type"), F.lit(0.75).alias("confidence"), F.col("ts").cast("timestamp").alias("at")
    )


def dead_letters(events: DataFrame) -> DataFrame:
    """Events of no known type, and those whose properties aren't JSON."""
    known = F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False))
    return events.where(~known | F.try_parse_json("props").isNull())


def deduplicated(events: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Each key once while it may come again within the delay: replays after a restart make no second row."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, group: str, length: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """(start, group, n, total) by tumbling or sliding windows; rows later than the delay are left out."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return events.withWatermark(at, delay).groupBy(w.alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), group, "n", "total")


def sessions(events: DataFrame, at: str, group: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """(start, end, group, n): runs of events without a gap, which is the debounced form of change notices."""
    return events.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), group).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n")


def debounced(events: DataFrame, group: str, at: str, quiet_s: int, most_s: int) -> DataFrame:
    """(key, first_us, last_us, n): a burst ends after quiet_s without an event, or most_s after its first one.

    State per key is three numbers. A burst comes out when a later event of its key closes it, or with the timer.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n = state.get if state.exists else (0, 0, 0)
        out = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(str(key[0]), first, last, n)], columns=["key", "first_us", "last_us", "n"])
            return
        times = sorted(t for b in batches for t in b["us"])
        for t in times:
            if n and (t - last >= quiet_s * 1_000_000 or t - first >= most_s * 1_000_000):
                out.append((str(key[0]), first, last, n))
                n = 0
            first, last, n = (t if not n else first), t, n + 1
        state.update((int(first), int(last), int(n)))
        state.setTimeoutTimestamp(max(int(last) // 1000 + quiet_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "first_us", "last_us", "n"])

    rows = events.withWatermark(at, "1 second").select(F.col(group), F.col(at), F.unix_micros(at).alias("us"))
    return rows.groupBy(group).applyInPandasWithState(step, "key string, first_us long, last_us long, n long", "first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def idempotent_sink(path: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that a repeated batch overwrites instead of doubling: one folder per batch id."""

    def write(df: DataFrame, batch: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write
