from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loamspark.streaming import events as ev
from loamspark.streaming import queue


def test_requests_of_one_key_meet(spark):
    q = spark.createDataFrame([(1, "pending", "a"), (2, "processing", "a"), (3, "done", "b"), (4, "pending", None)], "trigger_id int, status string, dedupe_key string")
    r = spark.createDataFrame([(10, "a"), (11, "b"), (12, "b"), (13, None), (14, None)], "request_id int, dedupe_key string")
    got = {x.request_id: (x.trigger_id, x.fresh) for x in queue.enqueue(q, r).collect()}
    assert got == {10: (2, False), 11: (11, True), 12: (11, False), 13: (13, True), 14: (14, True)}


def test_a_failed_send_is_sent_again(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "id string, at int")
    mark, sent = str(tmp_path / "mark"), []

    def fails(df):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        queue.sync_since(rows, "at", mark, fails)
    send = lambda df: sent.append(sorted(r.id for r in df.collect()))
    queue.sync_since(rows, "at", mark, send)
    more = rows.unionByName(spark.createDataFrame([("d", 3)], "id string, at int"))
    queue.sync_since(more, "at", mark, send)
    assert queue.sync_since(more, "at", mark, send) is None
    assert sent == [["a", "b"], ["d"]]


def test_stale_rows_fail_once(spark):
    at = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("processing", at, None, None), ("done", at, at, "x"), (None, at, None, None)], "status string, started_at timestamp, finished_at timestamp, error_text string")
    got = queue.fail_stale(rows, F.lit("2024-01-02 00:00:00").cast("timestamp"), 60).collect()
    assert [r.status for r in got] == ["failed", "done", None]
    assert got[0].error_text == "janitor_marked_stale_after_60s" and got[0].finished_at is not None


def bursts(times, quiet, most):
    out, held = [], []
    for t in sorted(times):
        if held and (t - held[-1] >= quiet or t - held[0] >= most):
            out.append((held[0], held[-1], len(held)))
            held = []
        held.append(t)
    return [*out, (held[0], held[-1], len(held))] if held else out


def test_debounced_stream_equals_a_walk(spark, tmp_path):
    data = [(k, i * 7919 % 4000 + 100) for i in range(60) for k in (1, 2)] + [(k, 9_000_000) for k in (1, 2, 3)]
    spark.createDataFrame(data, "user_id long, t long").select("user_id", F.timestamp_seconds("t").alias("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, at timestamp").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    ev.debounced(stream, "user_id", "at", 100, 600).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()
    got = sorted((int(r.key), r.first_us // 1_000_000, r.last_us // 1_000_000, r.n) for r in spark.read.parquet(out).collect() if r.first_us < 9_000_000 * 1_000_000)
    want = sorted((k, *b) for k in (1, 2) for b in bursts([t for u, t in data if u == k and t < 9_000_000], 100, 600))
    assert got == want
