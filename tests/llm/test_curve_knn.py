import numpy as np

from loamspark.llm import curve_knn as c

SCHEMA = "chunk_id string, embedding array<float>, updated_at int, key long"
DIM = 32


def clustered(rng, n):
    centres = rng.standard_normal((n // 25, DIM))
    return (centres[rng.integers(0, len(centres), n)] + 0.4 * rng.standard_normal((n, DIM))).astype(np.float32)


def vectors(spark, rows):
    return c.usable_vectors(spark.createDataFrame(rows, SCHEMA), "chunk_id", "embedding", "updated_at", DIM)


def truth(ids, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u.astype(np.float64) @ u.T, 9)
    np.fill_diagonal(s, -9)
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    return {ids[i]: [ids[j] for j in sorted(order, key=lambda j: -s[i, j])[:k] if j != i] for i in range(len(ids))}


def test_hilbert_visits_each_cell_once_by_neighbours():
    cells = np.array([(a, b) for a in range(8) for b in range(8)])
    keys = c.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(64))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_recall_in_many_blocks(spark):
    rng = np.random.default_rng(0)
    x, ids = clustered(rng, 3000), [f"c{i:05}" for i in range(3000)]
    s = c.Settings(block=64, landmarks=400, partition_rows=750)
    got = {r.id: r.near for r in c.nearest(vectors(spark, [(i, v.tolist(), 0, 1) for i, v in zip(ids, x, strict=True)]), s).collect()}
    want = truth(ids, x, 10)
    assert set(got) == set(ids) and all(len(v) == 10 and i not in v for i, v in got.items())
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in ids]) >= 0.9


def test_copies_take_the_smallest_ids(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.repeat(rng.standard_normal((1, DIM)), 40, 0), rng.standard_normal((20, DIM))]).astype(np.float32)
    ids = [f"c{i:03}" for i in range(60)]
    got = {r.id: r.near for r in c.nearest(vectors(spark, [(i, v.tolist(), 0, 1) for i, v in zip(ids, x, strict=True)])).collect()}
    assert set(got) == set(ids)
    for i in ids[:40]:
        assert got[i] == [j for j in ids[:11] if j != i][:10]


def test_unusable_and_older_rows(spark):
    one = [1.0] + [0.0] * (DIM - 1)
    rows = [("a", one, 1, 1), ("a", [0.0] * DIM, 2, 1), ("b", one, 2, 1), ("b", None, 1, 1), ("c", [2.0] * DIM, 1, 1), ("d", None, 1, 1), ("e", [1.0], 1, 1), ("f", [float("nan")] * DIM, 1, 1), ("g", [None] + one[1:], 1, 1), (None, one, 1, 1), ("h", one, None, 1)]
    got = {r.id: r.near for r in c.nearest(vectors(spark, rows)).collect()}
    assert got == {"b": ["h", "c"], "c": ["b", "h"], "h": ["b", "c"]}


def test_empty_and_single(spark):
    assert c.neighbour_pairs(c.nearest(vectors(spark, []))).collect() == []
    assert c.neighbour_pairs(c.nearest(vectors(spark, [("a", [1.0] * DIM, 1, 1)]))).collect() == []


def test_vectors_are_packed_without_loss():
    x = np.random.default_rng(2).standard_normal((7, DIM)).astype(np.float32) * np.float32(1e-20)
    assert (c._unpacked(c._packed(x)) == x).all()


def test_values_that_overflow_and_clashing_columns(spark):
    rows = [("a", [3e38] * DIM, 1, 1), ("b", [1e-38] * DIM, 1, 1), ("c", [float("inf")] + [1.0] * (DIM - 1), 1, 1)]
    got = {r.id: r.near for r in c.nearest(vectors(spark, rows)).collect()}
    assert got == {"a": ["b"], "b": ["a"]}
