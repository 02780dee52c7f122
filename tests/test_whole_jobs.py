"""Queries that do more than SQL of the registry tells, against plain Python."""

from collections import defaultdict

import __spark_entry__ as entry


def items(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/memory_items.parquet")
    return str(folder)


CLAIM = "id string, updated_at int, status string, source_session string, last_confirmed int"


def test_summary_holds_every_item(spark, tmp_path):
    rows = [(f"i{i:03}", 1, "active", "s1" if i < 57 else "s2", i) for i in range(60)]
    rows += [("i000", 2, "active", "s1", 500), ("n", 1, "active", None, 9), (None, 1, "active", "s1", 999), ("u", 1, "active", "s3", None)]
    got = defaultdict(set)
    for r in entry.queries()["SNK10_summary_all_items"](spark, items(spark, tmp_path, rows, CLAIM)).collect():
        got[r.source_session, r.n, r.last_confirmed].add(r.id)
    assert got == {("s1", 57, 500): {f"i{i:03}" for i in range(57)}, ("s2", 3, 59): {"i057", "i058", "i059"}, ("s3", 1, None): {"u"}}


def test_embedding_text_is_hashed_whole(spark, tmp_path):
    rows = [(i, "m.f", "f()", None, "x" * 3000 + end) for i, end in (("a", "1"), ("b", "2"))]
    spark.createDataFrame(rows, "id string, qualified_name string, signature string, docstring string, body string").write.parquet(f"{tmp_path}/code_chunks.parquet")
    got = {r.id: r.h for r in entry.queries()["FUN45_embedding_text"](spark, str(tmp_path)).collect()}
    assert got["a"] != got["b"]
