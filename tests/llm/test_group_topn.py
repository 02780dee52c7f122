import random
from datetime import datetime, timedelta

from loamspark.llm import group_topn


def test_against_brute_force(spark):
    rng = random.Random(2)
    data = [(rng.choice(["hot", "hot", f"g{n % 50}"]), "p", rng.randrange(20), f"i{n:04}") for n in range(2000)]
    df = spark.createDataFrame([(*r, "x") for r in data], "a string, b string, s long, id string, pos string").repartition(7)
    for n in (1, 3, 100):
        want = []
        for g in {r[:2] for r in data}:
            best = sorted((-r[2], r[3]) for r in data if r[:2] == g)[:n]
            want += [(*g, k + 1, i) for k, (_, i) in enumerate(best)]
        assert sorted(tuple(r) for r in group_topn.top_n(df, ["a", "b"], "s", "id", n).collect()) == sorted(want)


def test_small_batches_and_empty(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        df = spark.createDataFrame([("g", "p", 1, f"i{n}") for n in range(9)], "a string, b string, s long, id string").coalesce(1)
        assert [r.id for r in group_topn.top_n(df, ["a", "b"], "s", "id", 3).orderBy("pos").collect()] == ["i0", "i1", "i2"]
        assert group_topn.top_n(df.limit(0), ["a", "b"], "s", "id", 3).collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_claims_nulls_blanks_and_states(spark):
    t = lambda h: datetime(2025, 1, 1) + timedelta(hours=h)
    rows = [("a", "E ", "P", t(1), t(1)), ("a", "e", "p", t(5), t(2)), ("b", "e", " p", t(5), t(1)), ("c", "e", "p", None, t(1)), ("d", " ", "p", t(9), t(1)), ("e", None, "p", t(9), t(1)), (None, "e", "p", t(9), t(1)), ("b", "e", " p", t(5), t(1))]
    df = spark.createDataFrame(rows, "id string, entity string, property string, last_confirmed timestamp, updated_at timestamp")
    assert sorted(tuple(r) for r in group_topn.latest_claims(df).collect()) == [("e", "p", 1, "a"), ("e", "p", 2, "b")]
