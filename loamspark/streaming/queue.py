"""Trigger queues, checkpoints and sync marks, as table transformations that a micro-batch applies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamspark.session import exists

OPEN = ("pending", "processing")


def enqueue(queue: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, trigger_id, fresh): what each request (request_id, dedupe_key) becomes.

    Without a key it is a trigger of its own. With one, the newest open trigger of the key in queue(trigger_id, status,
    dedupe_key) answers it; else the key's first request becomes the trigger and answers the later ones.
    """
    open_ = queue.where(F.col("status").isin(*OPEN) & F.col("dedupe_key").isNotNull()).groupBy("dedupe_key").agg(F.max("trigger_id").alias("there"))
    first = requests.where("dedupe_key IS NOT NULL").groupBy("dedupe_key").agg(F.min("request_id").alias("first"))
    known = requests.join(open_, "dedupe_key", "left").join(first, "dedupe_key", "left")
    trigger = F.coalesce("there", "first", "request_id")
    return known.select("request_id", trigger.alias("trigger_id"), (F.col("there").isNull() & (trigger == F.col("request_id"))).alias("fresh"))


def fail_stale(rows: DataFrame, now: Column, seconds: int) -> DataFrame:
    """rows (status, started_at, finished_at, error_text) with those in `processing` for longer failed and marked."""
    stale = (F.col("status") == "processing") & (F.col("started_at") < now - F.make_dt_interval(secs=F.lit(seconds)))
    before = F.coalesce("error_text", F.lit(""))
    note = F.concat(before, F.when(before == "", "").otherwise("\n"), F.lit(f"janitor_marked_stale_after_{seconds}s"))
    return rows.withColumns({"error_text": F.when(stale, note).otherwise(F.col("error_text")), "finished_at": F.when(stale, now).otherwise(F.col("finished_at")), "status": F.when(stale, "failed").otherwise(F.col("status"))})


def checkpoints(begun: DataFrame, updates: DataFrame) -> DataFrame:
    """(checkpoint_id, status, finished_at): begun ones are `processing` until their last update (status, at) ends them.

    Updates of checkpoints that never began are left out.
    """
    last = updates.groupBy("checkpoint_id").agg(F.max_by("status", F.struct("at", "status")).alias("ended"), F.max("at").alias("finished_at"))
    return begun.join(last, "checkpoint_id", "left").select("checkpoint_id", F.coalesce("ended", F.lit("processing")).alias("status"), "finished_at")


def sync_since(rows: DataFrame, at: str, mark: str, send) -> DataFrame | None:
    """Send the rows after the mark stored at `mark` (all, if there is none); the mark moves only after send() returned.

    A run that fails in between sends its rows again: at least once. Returns what was sent, None if there was nothing.
    """
    spark = rows.sparkSession
    since = spark.read.parquet(mark).agg(F.max("through")).first()[0] if exists(spark, mark) else None
    fresh = rows.where(F.col(at).isNotNull()) if since is None else rows.where(F.col(at) > F.lit(since))
    through = fresh.agg(F.max(at).alias("through"))
    if through.first()[0] is None:
        return None
    send(fresh)
    through.write.mode("append").parquet(mark)
    return fresh
