from datetime import datetime

from pyspark.sql import functions as F

from loamspark.functions import dates
from loamspark.operators import retrieval, selection

NOW = datetime(2025, 3, 15, 12)


def test_since_and_time_references():
    assert dates.parse_since("2d", NOW) == datetime(2025, 3, 13, 12)
    assert dates.parse_since("yesterday", NOW) == datetime(2025, 3, 14)
    assert dates.parse_since("2025-01-02", NOW) == datetime(2025, 1, 2)
    assert dates.parse_since("", NOW) is None and dates.parse_since(None, NOW) is None
    assert dates.time_reference("in december", NOW) == (datetime(2024, 12, 1), datetime(2025, 1, 1))
    assert dates.time_reference("3 days ago", NOW) == (datetime(2025, 3, 11, 12), datetime(2025, 3, 13, 12))
    assert dates.time_reference("on 2025-02-30", NOW) is None and dates.time_reference("", NOW) is None


def test_greedy_packet_skips_what_does_not_fit(spark):
    rows = [("g", "a", "x" * 40, 9.0), ("g", "b", "X" * 40, 8.0), ("g", "c", "y" * 400, 7.0), ("g", "d", "z" * 8, 6.0), ("g", "e", None, 5.0), ("h", "f", "w", 1.0)]
    df = spark.createDataFrame(rows, "grp string, id string, text string, score double")
    got = selection.greedy_packet(df, "grp", "id", "text", "score", 50, 3, 20)
    assert sorted(tuple(r) for r in got.collect()) == [("g", "a", 1), ("g", "d", 2), ("g", "e", 3), ("h", "f", 1)]
    assert selection.greedy_packet(df.limit(0), "grp", "id", "text", "score", 50, 3, 20).collect() == []


def test_file_changes(spark):
    rows = [(None, None, 1, 5, None), (1, 5, 1, 9, True), (1, 5, 1, 5, True), (1, 5, 1, 3, True), (1, 5, 2, 9, True), (1, 5, 1, 9, False), (1, 5, None, None, None)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e boolean")
    got = [r[0] for r in df.select(selection.file_change(*[F.col(x) for x in "abcde"])).collect()]
    assert got == ["fresh", "append", "unchanged", "truncated", "rotated", "rotated", "unknown"]


def test_hashed_vectors(spark):
    df = spark.createDataFrame([("a", "gate port"), ("b", "port GATE!"), ("c", None), ("d", "")], "id string, text string")
    got = {r.id: r.embedding for r in retrieval.hashed_vectors(df, "id", "text", 16).collect()}
    assert got["a"] == got["b"] and abs(sum(x * x for x in got["a"]) - 1) < 1e-6
    assert got["c"] == got["d"] == [0.0] * 16
