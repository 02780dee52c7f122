import json

from pyspark.sql import functions as F

from loamspark.operators import search, graph, joins, retrieval, store, temporal
from loamspark.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_keeps_first_and_lets_nulls_win(spark):
    old = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "id string, v string, first string")
    new = spark.createDataFrame([("b", None, "z"), ("c", "3", "w")], "id string, v string, first string")
    assert rows(store.upsert(old, new, ["id"], keep_first=["first"])) == [("a", "1", "x"), ("b", None, "y"), ("c", "3", "w")]


def test_sparse_update_and_append_new(spark):
    old = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "id string, x int, y int")
    assert rows(store.sparse_update(old, spark.createDataFrame([("a", None, 9)], "id string, x int, y int"), "id")) == [("a", 1, 9), ("b", 3, 4)]
    assert rows(store.append_new(old, spark.createDataFrame([("b", 0, 0), ("c", 5, 5), ("c", 5, 5)], "id string, x int, y int"), "id")) == [("c", 5, 5)]


def test_conflicts_count_without_pairs(spark):
    df = spark.createDataFrame([("1", "s", "a"), ("2", "s", "a"), ("3", "s", "b"), ("4", "s", None), ("5", "t", "a"), ("6", None, "a"), ("7", None, "b")], "id string, slot string, v string")
    assert rows(joins.conflicts(df, ["slot"], "v", "id").select("id", "value_class", "conflicting")) == [("1", "1", 2), ("2", "1", 2), ("3", "3", 3), ("4", "4", 3), ("6", "6", 1), ("7", "7", 1)]


def test_point_in_range_prefers_the_smallest(spark):
    ranges = spark.createDataFrame([("f", "outer", 1, 1000), ("f", "inner", 10, 20), ("g", "other", 1, 9)], "file string, name string, lo int, hi int")
    points = spark.createDataFrame([("p", "f", 15), ("q", "f", 999), ("r", "f", 2000), ("s", "g", 9)], "pid string, file string, line int")
    got = joins.point_in_range(points, ranges, ["file"], "line", "lo", "hi", "pid", [F.col("hi") - F.col("lo")], 64)
    assert rows(got.select("pid", "name")) == [("p", "inner"), ("q", "outer"), ("s", "other")]


def test_k_hops_ends_in_cycles(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "a", "x"), ("c", "d", "y")], "src string, dst string, type string")
    start = spark.createDataFrame([("a",)], "id string")
    assert rows(graph.k_hops(e, start, 4).select("node", "hops")) == [("b", 1), ("c", 1), ("d", 2)]
    assert rows(graph.k_hops(e, start, 4, ["x"]).select("node", "hops")) == [("b", 1), ("c", 1)]
    assert rows(graph.k_hops(e.limit(0), start, 2)) == []


def test_cover_density_is_the_shortest_window(spark):
    df = spark.createDataFrame([("a", "compiler gave many warnings, compiler warning"), ("b", "compiler only"), ("c", None), ("d", "")], "id string, text string")
    got = {r.id: r.d for r in df.select("id", retrieval.cover_density(["compiler", "warnings"], "text").alias("d")).collect()}
    assert got == {"a": 0.5, "b": 0.0, "c": 0.0, "d": 0.0}


def test_query_terms():
    assert retrieval.query_terms("What about THE Compiler-warnings, cpu?") == ["what", "compiler", "warnings"]


def test_rerank_and_metrics(spark):
    df = spark.createDataFrame([(str(i), 10.0 - i, float(i)) for i in range(6)], "id string, score double, raw double")
    rows = {r.id: r for r in search.rerank(df, [F.desc("score")], ["id"], 3, F.col("raw") * 10, True).collect()}
    assert len(rows) == df.count() and [i for i, r in sorted(rows.items(), key=lambda x: x[1].place or 9)][0] == "1"
    assert sum(r.place is None for r in rows.values()) == df.count() - 3
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("z", "a", 1)], "query string, item string, rank int")
    relevant = spark.createDataFrame([("q", "b", 1.0), ("q", "c", 1.0)], "query string, item string, gain double")
    got = {r["query"]: (r.recall, r.precision, r.mrr) for r in retrieval.metrics_at(ranked, relevant, "query", "item", 2).collect()}
    assert got == {"q": (0.5, 0.5, 0.5), "z": (0.0, 0.0, 0.0)}


def test_temporal_edges(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (7.0,), (31.0,), (None,)], "age double")
    assert [r[0] for r in df.select(temporal.bucket(F.col("age"))).collect()] == ["today", "this_week", "this_month", "older", "undated"]
    assert df.select(temporal.half_life(F.col("age"), 1.0, 0.6).alias("r")).collect()[1].r == 0.3


def test_json_lines_and_transcripts(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    good = {"type": "message", "id": "1", "timestamp": "2025-01-01T00:00:00Z", "message": {"role": "user", "content": [{"type": "text", "text": "<think>no</think> hi"}, {"type": "tool", "text": "x"}]}}
    p.write_text(json.dumps(good) + "\n\n{broken\n")
    assert files.json_lines(spark, str(p), files.TRANSCRIPT).where("id IS NOT NULL").count() == 1
    ok, bad = files.json_lines_with_bad(spark, str(p), files.TRANSCRIPT)
    assert [r.text for r in files.transcript_texts(ok).collect()] == ["hi"]
    assert [r.value for r in bad.collect()] == ["{broken"]
    text = spark.createDataFrame([('{"a":1}\nNONE\n{x',)], "t string")
    assert rows(files.embedded_json(text, "t", "a int").where("a IS NOT NULL")) == [(1,)]


def test_directory_snapshot_markdown_and_code(spark, tmp_path):
    (tmp_path / "a.md").write_text("# t\n- one\ntext\n## two\n")
    (tmp_path / "b.py").write_text("class A:\n    def m(self):\n        'doc'\n        def n(): pass\n\ndef f(): pass\n")
    snap = files.directory_snapshot(spark, str(tmp_path))
    assert snap.count() == 2 and snap.where("length(sha1) = 40").count() == 2
    assert sorted(r.line for r in files.markdown_lines(spark, str(tmp_path)).collect()) == ["## two", "- one"]
    code = spark.createDataFrame([("b.py", (tmp_path / "b.py").read_text()), ("bad.py", "def ("), ("null.py", None)], "path string, code string")
    assert rows(files.python_chunks(code).select("kind", "name")) == [("class", "A"), ("function", "A.m.n"), ("function", "f"), ("method", "A.m")]
