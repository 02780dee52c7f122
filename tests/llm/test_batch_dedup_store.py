import random

import numpy as np
from loamspark.llm import batch_dedup as b
from test_batch_dedup import SCHEMA, brute, family

STOCK = "ten words that all of these records have in common"


def rows_of(spark, rows):
    return b.records(spark.createDataFrame(rows, SCHEMA))


def test_a_chunk_of_hundreds_of_records_loses_no_match(spark):
    rows = [(f"k{i:03}", True, None, f"own{i} {STOCK}", None, 7) for i in range(200)] + [("n", False, 1, f"other {STOCK}", None, 7)]
    assert b.match_in_order(rows_of(spark, rows)).count() == 200
    ends = [(f"k{i:03}", True, None, f"{STOCK} own{i}", None, 7) for i in range(200)] + [("n", False, 1, f"{STOCK} other", None, 7)]
    assert b.match_in_order(rows_of(spark, ends)).count() == 200


def test_tiles_meet_each_pair(spark, monkeypatch):
    rows = family(random.Random(8), 260, base_share=0.5)
    want = {tuple(r) for r in b.match_in_order(rows_of(spark, rows)).collect()}
    monkeypatch.setattr(b, "HOT", 4)
    monkeypatch.setattr(b, "COUNTED", 1)
    assert {tuple(r) for r in b.match_in_order(rows_of(spark, rows)).collect()} == want


def test_short_texts_in_any_order_are_exact(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        t = [f"s{j}" for j in range(12)]
        for at in rng.sample(range(12), 2):
            t[at] = f"e{i}x{at}"
        rng.shuffle(t)
        rows.append((f"i{i:03}", i % 4 == 0, None if i % 4 == 0 else i, " ".join(t), None, 7))
    assert {tuple(r) for r in b.match_in_order(rows_of(spark, rows)).collect()} == brute(rows)


def test_any_passes_and_buckets_give_the_same(spark, tmp_path):
    rows = family(random.Random(12), 160)
    got = []
    for buckets, step in ((1, 80), (9, 20)):
        store = b.ChunkStore(spark, str(tmp_path / f"store{buckets}"), buckets)
        store.append(rows_of(spark, [r for r in rows if r[1]]))
        found = set()
        for lo in range(0, 80, step):
            batch = [r for r in rows if not r[1] and lo <= r[2] < lo + step]
            found |= {tuple(r) for r in store.add_batch(rows_of(spark, batch)).collect()}
        got.append(found)
    assert got[0] == got[1]


def test_a_batch_reads_the_buckets_of_its_chunks_only(spark, tmp_path):
    store = b.ChunkStore(spark, str(tmp_path / "store"), 64)
    store.append(rows_of(spark, [r for r in family(random.Random(1), 300, base_share=1.0)]))
    one = rows_of(spark, [("n", False, 1, f"own {STOCK}", None, 7)])
    wanted = one.selectExpr("explode(keys) AS k")
    read = store._in_buckets(store.chunks(), wanted, "k")
    hit = {r.bucket for r in wanted.select(store._bucket("k").alias("bucket")).collect()}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    assert {r.bucket for r in read.select("bucket").distinct().collect()} <= hit and len(hit) < 10


def test_chunks_cut_in_one_pass_equal_a_walk():
    rng = np.random.default_rng(6)
    n = 400
    hashes, ends, sizes = rng.integers(0, 2**64, n, np.uint64), rng.random(n) < 0.5, rng.integers(1, 9, n)
    first = rng.random(n) < 0.1
    first[0] = True
    want, held = [], 0
    for i in range(n):
        held = 1 if first[i] else held + 1
        if (ends[i] and held >= 2) or i + 1 == n or first[i + 1]:
            want.append(i)
            held = 0
    last, keys = b._chunks(hashes, ends, sizes, first)
    assert last.tolist() == want
    start = 0
    for i, k in zip(want, keys.tolist(), strict=True):
        h = 0
        for j in range(start, i + 1):
            h = (h * b._MULTIPLY + int(hashes[j])) % 2**64
        assert k == (h ^ h >> 29) & ~255 & (2**64 - 1) | min(int(sizes[start : i + 1].sum()), 255)
        start = i + 1


def test_passes_take_whole_days_together(spark):
    day = 86_400_000_000
    at = spark.createDataFrame([(d * day + i,) for d, n in ((1, 3), (2, 1), (5, 4), (6, 1)) for i in range(n)], "at long")
    assert b.passes(at, 4) == [(day, 3 * day), (5 * day, 6 * day), (6 * day, 7 * day)]
    assert b.passes(at, 1) == [(d * day, (d + 1) * day) for d in (1, 2, 5, 6)]
    assert b.passes(at.where("at < 0"), 4) == []
