import random

from loamspark.llm import batch_dedup as b
from loamspark.llm.words import words

SCHEMA = "id string, base boolean, at long, text string, payload string, n int"


def brute(rows):
    known = [(r[0], set(words(r[3]))) for r in rows if r[1]]
    out = set()
    for r in sorted((r for r in rows if not r[1]), key=lambda r: (r[2], r[0])):
        s = set(words(r[3]))
        if len(s) < b.LEAST_WORDS:
            continue
        found = [i for i, k in known if len(k) >= b.LEAST_WORDS and 10 * len(s & k) >= 7 * len(s | k)]
        out |= {(r[0], i) for i in found}
        if not found:
            known.append((r[0], s))
    return out


def family(rng, n, base_share=0.3, vocabulary=400):
    texts, rows = [], []
    for i in range(n):
        if texts and rng.random() < 0.6:
            t = rng.choice(texts).split()
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = f"w{rng.randrange(vocabulary)}"
            if rng.random() < 0.2:
                k = rng.randrange(len(t))
                t = t[k:] + t[:k]
        else:
            t = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(6, 40))]
        texts.append(" ".join(t))
        base = rng.random() < base_share
        rows.append((f"i{i:05}", base, None if base else rng.randrange(n // 2), texts[-1], None, 7))
    return rows


def test_against_brute_force(spark):
    rows = family(random.Random(4), 700)
    got = {tuple(r) for r in b.match_in_order(b.records(spark.createDataFrame(rows, SCHEMA))).collect()}
    want = brute(rows)
    assert got <= want
    assert len(got) >= 0.99 * len(want)


def test_hot_chunks_and_copies(spark, monkeypatch):
    monkeypatch.setattr(b, "HOT", 3)
    monkeypatch.setattr(b, "BROADCAST_ROWS", 5)
    stock = "please do not touch the common gate while the reviewer is away today"
    rows = [(f"c{i:03}", i % 3 == 0, None if i % 3 == 0 else i, stock, None, 7) for i in range(60)]
    rows += [(f"d{i:03}", False, 100 + i, f"{stock} item{i} part{i}", None, 7) for i in range(40)]
    got = {tuple(r) for r in b.match_in_order(b.records(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == brute(rows)


def test_nulls_short_long_and_empty(spark):
    rows = [("a", True, None, None, None, 7), ("b", True, None, "one two three", None, 7), ("c", False, 1, "one two three", None, 7), (None, False, 1, "a b c d e f g", None, 7), ("d", False, 2, "x " * 10, None, 7), ("e", True, None, " ".join(f"w{i}" for i in range(5000)), None, 7), ("f", False, 3, " ".join(f"w{i}" for i in range(4900)), None, 7)]
    assert {tuple(r) for r in b.match_in_order(b.records(spark.createDataFrame(rows, SCHEMA))).collect()} == {("f", "e")}
    assert b.match_in_order(b.records(spark.createDataFrame([], SCHEMA))).collect() == []


def test_payloads():
    assert b.payload_text('{"text": "t"}') == "t"
    assert b.payload_text('{"text": null, "normalized_text": "n"}') == "n"
    assert [b.payload_text(x) for x in (None, "", "{", "[]", "3", '{"text": 5}', "{}")] == [None] * 7


def test_batches_in_a_store_equal_one_run(spark, tmp_path):
    rows = family(random.Random(9), 160)
    store = b.ChunkStore(spark, str(tmp_path / "store"))
    store.append(b.records(spark.createDataFrame([r for r in rows if r[1]], SCHEMA)))
    got = set()
    for lo in (0, 40):
        batch = [r for r in rows if not r[1] and lo <= r[2] < lo + 40]
        got |= {tuple(r) for r in store.add_batch(b.records(spark.createDataFrame(batch, SCHEMA))).collect()}
    want = {tuple(r) for r in b.match_in_order(b.records(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == want
