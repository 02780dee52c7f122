import itertools
import random

from loamspark.operators import search


def brute(words, groups):
    """Covers by trying all runs: minimal ones that hold each group's word."""
    full = [(i, j) for i in range(len(words)) for j in range(i, len(words)) if all(any(w in g for w in words[i : j + 1]) for g in groups)]
    least = [r for r in full if not any(o != r and o[0] >= r[0] and o[1] <= r[1] for o in full)]
    return sum(search.COVER / (1 + max(0, j - i - (len(groups) - 1))) for i, j in least)


def test_covers_against_all_runs():
    rng = random.Random(2)
    for n, k in itertools.product(range(0, 14), (1, 2, 3)):
        words = [rng.choice("abcdx") for _ in range(n)]
        groups = [["a"], ["b", "c"], ["d"]][:k]
        got = search.covers(words, [[[w] for w in g] for g in groups], [])
        assert abs(got - brute(words, groups)) < 1e-9


def test_web_query_syntax():
    assert search.web_query('stale "old ring" or rings -owner') == ([[["stale"]], [["old", "r"], ["ring"]]], [["owner"]])
    assert search.covers("an old ring".split(), [[["old", "ring"]]], []) == search.COVER
    assert search.covers("an old ring".split(), [[["old"]]], [["ring"]]) == 0.0
    assert search.covers([], [], []) == 0.0


def test_rank_and_vectors_of_nulls_and_long_texts(spark):
    rows = [("a", "The Snapshot! its owners", None), ("b", None, "snapshot owner"), ("c", "", ""), ("d", "x " * 30_000 + "snapshot owner", None)]
    df = spark.createDataFrame(rows, "id string, text string, value string")
    got = {r.id: r.f for r in df.select("id", search.text_rank("snapshot owner", ["text", "value"]).alias("f")).collect()}
    assert got == {"a": 0.05, "b": 0.1, "c": 0.0, "d": 0.1}
    vectors = {r.id: r.vector for r in search.vector_scores(df, "id", "text", "snapshot owner").collect()}
    assert set(vectors) == {"a", "d"} and vectors["a"] > vectors["d"]
    assert search.vector_scores(df.limit(0), "id", "text", "x").collect() == []


def test_rerank_of_empty_and_short_tables(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, score double")
    again = search.rerank(df, [F.desc("score")], ["id"], 12, -F.col("score"), False)
    assert [(r.id, r.place) for r in again.orderBy("place").collect()] == [("a", 1), ("b", 2)]
    assert search.rerank(df.limit(0), [F.desc("score")], ["id"], 12, F.col("score"), True).collect() == []
