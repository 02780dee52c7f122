import re

import numpy as np
from loamspark.llm import batch_dedup as b
from loamspark.llm.words import words


def test_limits_equal_the_conditions_on_sizes_and_maps():
    num, den = b.SHARE
    x, y, apart = np.ogrid[:256, :256, : b.MAP_BITS + 1]
    want = ((np.minimum(x, y) * den >= np.maximum(x, y) * num) & (apart * (den + num) <= (x + y) * (den - num))) | (np.maximum(x, y) == b.TOP_WORDS)
    assert ((apart < b._LIMITS[x, y]) == want).all()


def test_comparisons_shuffle_and_sort_two_numbers_a_posting(spark, monkeypatch):
    """Tiles and roles are within the key and the tag, so that a posting is 16 bytes and one number orders all."""
    monkeypatch.setattr(b, "HOT", 4)
    known = spark.createDataFrame([(256 * k + 7, t << 8 | 9) for k in (1, 2) for t in range(3 + 20 * (k == 2))], "k long, tag long")
    new = spark.createDataFrame([(256 * k + 7, (100 + t) << 8 | 9) for k in (1, 2) for t in range(2 + 10 * (k == 2))], "k long, tag long")
    counts = spark.createDataFrame([(2 * 256 + 7, 23, False), (2 * 256 + 7, 12, True)], "k long, n long, fresh boolean")
    tiled = b._tiled(known, new, counts)
    assert tiled.dtypes == [("k", "bigint"), ("tag", "bigint")]
    rows = [(r.k, r.tag % 2**64 >> 62, r.tag & (1 << 62) - 1) for r in tiled.collect()]
    assert all(k & 255 == 7 for k, _, _ in rows)
    assert not any(k == 2 * 256 + 7 for k, _, _ in rows)
    assert {(role, tag) for k, role, tag in rows if k == 256 + 7} == {(b.KNOWN, t << 8 | 9) for t in range(3)} | {(b.NEW, (100 + t) << 8 | 9) for t in range(2)}
    tiles = {}
    for k, role, tag in rows:
        if k != 256 + 7:
            tiles.setdefault(k, []).append((role, tag))
    met = [(x, y) for t in tiles.values() for r, x in t if r == b.SEEKING for s, y in t if s in (b.KNOWN, b.SOUGHT)]
    assert len(met) == len(set(met)) == 12 * (23 + 12)


def test_hashes_are_sorted_and_single_where_their_upper_bits_agree():
    rng = np.random.default_rng(3)
    row = np.sort(rng.integers(0, 9, 500))
    hashes = np.uint64(1 << 63) + rng.integers(0, 40, 500).astype(np.uint64)
    for h in (hashes, rng.integers(0, 2**64, 500, np.uint64)):
        got = b._sorted_hashes(row, h, 9)
        assert list(zip(*map(np.ndarray.tolist, got), strict=True)) == sorted({*zip(row.tolist(), h.tolist(), strict=True)})
    assert [len(x) for x in b._sorted_hashes(row[:0], hashes[:0], 0)] == [0, 0]


def test_a_table_in_buckets_is_written_without_a_sort(spark, tmp_path):
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    with b._writers(spark):
        assert int(spark.conf.get(name)) == b.WRITERS
    assert spark.conf.get(name, None) == before
    store = b.ChunkStore(spark, str(tmp_path / "store"), 20)
    rows = [(f"i{i}", True, None, f"one two three four five six own{i}", None) for i in range(50)]
    store.append(b.records(spark.createDataFrame(rows, "id string, base boolean, at long, text string, payload string")))
    assert store.accepted().count() == 50 and store.accepted().select("bucket").distinct().count() > b.WRITERS
    assert store._sampled().count() <= 50


def test_current_rows_shuffle_no_text_of_single_rows(spark):
    rows = spark.createDataFrame([("a", "2026-01-01", "x"), ("a", "2026-01-02", "y"), ("b", None, "z"), ("c", "2026-01-01", None), (None, "2026-01-01", "n"), ("d", None, "p"), ("d", None, "q"), ("d", "2025-01-01", "r")], "id string, discarded_at string, payload string")
    got = b._current(rows, "discarded_at", ["discarded_at", "payload"])
    assert sorted((tuple(r) for r in got.collect()), key=str) == [("a", "2026-01-02", "y"), ("b", None, "z"), ("c", "2026-01-01", None), ("d", "2025-01-01", "r")]
    want = b.current_rows(rows, "id", "discarded_at", ["discarded_at", "payload"])
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_matches_of_a_batch_come_once(spark, tmp_path):
    """Several texts with one tag, copies among them and of what is known: each match is one row."""
    rows = [(f"k{i}", True, None, f"one two three four five six own{i % 3}", None, 7) for i in range(6)]
    rows += [(f"n{i}", False, i, f"one two three four five six own{i % 4}", None, 7) for i in range(12)]
    store = b.ChunkStore(spark, str(tmp_path / "store"))
    schema = "id string, base boolean, at long, text string, payload string, n int"
    store.append(b.records(spark.createDataFrame([r for r in rows if r[1]], schema)))
    got = [tuple(r) for r in store.add_batch(b.records(spark.createDataFrame([r for r in rows if not r[1]], schema))).collect()]
    assert len(got) == len(set(got)) and set(got) == {(f"n{i}", f"k{j}") for i in range(12) for j in range(6)}


def test_ascii_texts_have_the_words_of_the_expression():
    for c in range(128):
        text = f"Ab{chr(c)}cD{chr(c)} {chr(c)}{chr(c)}x_Y"
        assert words(text) == re.findall(r"[^\W_]+", text.lower())
        assert words(text + "é") == re.findall(r"[^\W_]+", (text + "é").lower())


def test_copies_of_a_known_class_dont_multiply(spark):
    """A class with many known copies meets its new copies once."""
    text = "one two three four five six seven"
    rows = [(f"k{i}", True, None, text, None, 7) for i in range(40)] + [(f"n{i}", False, i, text, None, 7) for i in range(30)]
    got = b.match_in_order(b.records(spark.createDataFrame(rows, "id string, base boolean, at long, text string, payload string, n int")))
    assert got.count() == 30 * 40
