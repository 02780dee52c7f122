import random

from loamspark.llm import batch_dedup as b
from test_batch_dedup import SCHEMA, brute


def test_hot_chunks_without_a_common_run(spark, monkeypatch):
    monkeypatch.setattr(b, "HOT", 2)
    rng = random.Random(5)
    stock = [f"stock{i}" for i in range(12)]
    rows = []
    for i in range(150):
        t = list(stock)
        for k, at in enumerate(rng.sample(range(12), 2)):
            t[at] = f"edit{i}x{k}"
        rows.append((f"i{i:03}", i % 5 == 0, None if i % 5 == 0 else i, " ".join(t), None, 7))
    got = {tuple(r) for r in b.match_in_order(b.records(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == brute(rows)


def test_frequent_chunks_meet_by_their_rarest_other_words(spark, monkeypatch):
    """Holders of a frequent chunk that share no other word aren't compared, and no match is lost."""
    monkeypatch.setattr(b, "HOT", 16)
    monkeypatch.setattr(b, "COUNTED", 1)
    monkeypatch.setattr(b, "HELD_SAMPLE", 1, raising=False)
    rng = random.Random(9)
    rows = []
    for i in range(400):
        of = f"f{i % 100}"
        t = [f"{of}w{j}" for j in range(14)]
        t[rng.randrange(14)] = f"e{i}"
        text = " ".join(["what all of these open with", *t]) if i % 40 else "what all of these open with today"
        rows.append((f"i{i:03}", i % 5 == 0, None if i % 5 == 0 else i, text, None, 7))
    met, tiled = [], b._tiled

    def watched(known, new, counts):
        n = known.groupBy("k").count().withColumnRenamed("count", "a").join(new.groupBy("k").count().withColumnRenamed("count", "f"), "k", "full").fillna(0)
        met.append(n.selectExpr("sum(f * (a + f))").first()[0])
        return tiled(known, new, counts)

    monkeypatch.setattr(b, "_tiled", watched)
    got = {tuple(r) for r in b.match_in_order(b.records(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == brute(rows) and len(got) > 100
    assert met[0] < 320 * 400 / 2


def test_passes_grow_with_what_is_known(spark, monkeypatch, tmp_path):
    """Each pass reads the store, so their number mustn't grow with the tables."""
    spark.createDataFrame([(f"k{i}", f"one two three four five six own{i}", "2026-01-01") for i in range(80)], "id string, text string, updated_at string").write.parquet(f"{tmp_path}/memory_items.parquet")
    spark.createDataFrame([(f"d{i}", f"2026-02-{1 + i:02} 00:00:00", '{"text": "one two three four five six"}') for i in range(20)], "id string, discarded_at string, payload string").write.parquet(f"{tmp_path}/memory_discarded.parquet")
    monkeypatch.setattr(b, "PASS_RECORDS", 2)
    found, ran, passes = [], [], b.passes
    monkeypatch.setattr(b, "passes", lambda at, size: ran.extend(passes(at, size)) or ran)
    found = b.duplicate_claims(spark, str(tmp_path)).count()
    assert found == 20 * 80 and len(ran) == 1
