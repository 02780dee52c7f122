import random

from loamspark.operators.copydiff import diff_copies, store_parity

S = "id string, a string, n double, key string"


def test_against_brute_force(spark):
    rng = random.Random(3)
    make = lambda: {f"k{rng.randrange(400)}": (rng.choice([None, "", "x", "X", "y" * 100, "y" * 99 + "z"]), rng.choice([None, 0.0, 1.5])) for _ in range(300)}
    left, right = make(), make()
    df = lambda m: spark.createDataFrame([(k, *v, "clash") for k, v in m.items()], S)
    got = sorted(tuple(r) for r in diff_copies(df(left), df(right), "id", ["a", "n"]).collect())
    want = [(k, "missing_right", "") for k in left if k not in right] + [(k, "missing_left", "") for k in right if k not in left]
    want += [(k, "differs", f) for k in left if k in right for i, f in enumerate(["a", "n"]) if left[k][i] != right[k][i]]
    assert got == sorted(want)


def test_empty_sides(spark):
    none = spark.createDataFrame([], S)
    one = spark.createDataFrame([("k", "v", 1.0, "c"), (None, "v", 1.0, "c")], S)
    assert diff_copies(none, none, "id", ["a"]).collect() == []
    assert [tuple(r) for r in diff_copies(one, none, "id", ["a"]).collect()] == [("k", "missing_right", "")]
    assert [tuple(r) for r in diff_copies(none, one, "id", ["a"]).collect()] == [("k", "missing_left", "")]


def test_many_equal_neighbours_in_small_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        left = spark.createDataFrame([(f"{k:04}", "v", 1.0, "") for k in range(50)], S)
        right = spark.createDataFrame([(f"{k:04}", "w", 1.0, "") for k in range(25, 75)], S)
        got = [tuple(r) for r in diff_copies(left, right, "id", ["a", "n"]).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(got) == sorted([(f"{k:04}", "missing_right", "") for k in range(25)] + [(f"{k:04}", "missing_left", "") for k in range(50, 75)] + [(f"{k:04}", "differs", "a") for k in range(25, 50)])


def test_store_parity_rules(spark):
    items = spark.createDataFrame(
        [("a", "t", None, "e", "p", "v", None, 1, "fact", "active"), ("b", "t", "s", None, "p", "v", 0.5, 1, "fact", "active"), ("b", "old", "s", "e", "p", "v", 0.5, 0, "fact", "active")],
        "id string, text string, scope string, entity string, property string, value string, confidence double, updated_at int, memory_type string, status string",
    ).selectExpr("*", "cast(null as double) AS importance")
    points = spark.createDataFrame([("1", '{"id":"a","text":"t","entity":"e","property":"p","value":"v","memory_type":"fact","status":"active","confidence":null}', 2), ("2", '{"memory_id":"b","text":"T","scope":"s","property":"p","value":"v","confidence":"0.500","memory_type":"fact","status":"active"}', 1)], "point_id string, payload string, updated_at int")
    nodes = spark.createDataFrame([(0, "a", "t", "stable", "fact", 0.0, 0.0, "e", "p", "v")], "node_no long, id string, text string, scope string, memory_type string, confidence double, importance double, entity string, property string, value string")
    report = spark.createDataFrame([("r", ["a", "b", None], ["a", "b", "q"], ["a", "n"]), ("r", None, ["a"], None), ("old", ["zz"], None, None)], "report_id string, pg_ids array<string>, qdrant_ids array<string>, neo4j_ids array<string>")
    got = sorted(tuple(r) for r in store_parity(items, points, nodes, report, "r").collect())
    assert got == [("b", "stale_vector", "text"), ("n", "orphan_in_neo4j", ""), ("q", "orphan_in_qdrant", "")]
