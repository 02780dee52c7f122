from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loamspark.streaming import events as ev

T0 = datetime(2025, 1, 1)


def run(spark, tmp_path, batches, schema, build, name):
    src = tmp_path / "in"
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        q = build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(out).collect())


def test_replays_come_once(spark, tmp_path):
    b = [(1, T0), (2, T0 + timedelta(minutes=1))]
    got = run(spark, tmp_path, [b, b + [(3, T0 + timedelta(minutes=2))]], "event_id long, at timestamp", lambda s: ev.deduplicated(s, "event_id", "at", "1 day").select("event_id"), "d")
    assert got == [(1,), (2,), (3,)]


def test_debounce_closes_by_quiet_and_by_age(spark, tmp_path):
    s = lambda x: T0 + timedelta(seconds=x)
    first = [("k", s(0)), ("k", s(1)), ("k", s(10)), ("k", s(12)), ("k", s(14)), ("k", s(16))]
    got = run(spark, tmp_path, [first, [("z", s(1000))], [("z", s(2000))]], "k string, at timestamp", lambda d: ev.debounced(d, "k", "at", 5, 6), "b")
    assert [r[3] for r in got if r[0] == "k"] == [2, 3, 1]


def test_sink_overwrites_a_repeated_batch(spark, tmp_path):
    sink = ev.idempotent_sink(str(tmp_path / "sink"), lambda d: d.withColumn("y", F.col("id") + 1))
    df = spark.range(3)
    sink(df, 0)
    sink(df, 0)
    sink(df, 1)
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 6


def test_dead_letters(spark):
    df = spark.createDataFrame([(1, "view", "{}"), (2, "odd", "{}"), (3, None, "{}"), (4, "view", "{x"), (5, "view", None)], "event_id long, event_type string, props string")
    assert sorted(r.event_id for r in ev.dead_letters(df).collect()) == [2, 3, 4, 5]
