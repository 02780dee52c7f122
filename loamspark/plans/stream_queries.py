"""Queries on event streams, run to the end over the events table (STR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamspark.plans.common import Registry
from loamspark.session import shared_dir, table
from loamspark.streaming import events as ev

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL


def _drain(s, d, build, mode: str = "append"):
    """Run a streaming query over all there is and return what it wrote."""
    import uuid

    out = f"{shared_dir(s)}/loamspark-stream-{uuid.uuid4().hex}"
    batch = table(s, d, "events")
    stream = s.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(d)
    q = build(stream.withColumn("at", F.col("ts").cast("timestamp"))).writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return s.read.parquet(out)


@R("STR01_event_items", "SELECT 'stream-' || event_id AS id, coalesce(props, '') AS text, event_type AS memory_type, 0.75 AS confidence FROM events WHERE event_type IN ('signup', 'error', 'click', 'view', 'purchase')")
def _(s, d):
    return _drain(s, d, ev.event_items).drop("at")


@R("STR04_latency_stats", "SELECT round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, quantile_disc(value, 0.99) AS p99 FROM events")
def _(s, d):
    return table(s, d, "events").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY value)").alias("p99"))


@R("STR06_deduplicated", "SELECT DISTINCT event_id, event_type FROM events")
def _(s, d):
    return _drain(s, d, lambda e: ev.deduplicated(e, "event_id", "at", "1 day").select("event_id", "event_type"))


@R("STR07_sessions", """
SELECT user_id, count(*) AS n, min(ts) AS first_ts FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, grp""")
def _(s, d):
    e = table(s, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return ev.sessions(e, "at", "user_id", "12 hours").select("user_id", "n", F.col("start").cast("timestamp_ntz").alias("first_ts"))


@R("STR_tumbling_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(s, d):
    e = table(s, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return ev.windowed_counts(e, "at", "event_type", "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@R("STR_sliding_windows", """
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start, event_type, value FROM events) GROUP BY ALL""")
def _(s, d):
    e = table(s, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return ev.windowed_counts(e, "at", "event_type", "2 days", "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
