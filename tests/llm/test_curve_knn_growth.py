import dataclasses
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from loamspark.llm import curve_knn as c


def test_sample_is_bounded_and_the_compared_share_falls():
    small, large = c.Settings.for_rows(80_000), c.Settings.for_rows(80_000_000)
    assert small.landmarks == 10_000 and large.sample == 262_144
    assert 3 * small.orderings * small.block / 80_000 < 0.03
    assert 3 * large.orderings * large.block / 80_000_000 < 0.001


def near_in_one_process(x, s):
    """What each ordering's partitions yield, run one after the other without a session."""
    ids = np.array([f"c{i:04}" for i in range(len(x))])
    o = c.Orderings(c._unit(x) @ c._projection(x.shape[1], s.sketch), len(x), s)
    shared = SimpleNamespace(value=o)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
    at = list(c._first(shared)([pa.record_batch([pa.array(ids), flat], ["id", "embedding"])]))
    placed = {}
    for t in range(s.orderings):
        rows = pa.Table.from_batches(at)
        placed[t] = {r["id"]: r["part"] for r in rows.to_pylist() if not r["guest"]}
        at = []
        for p in range(o.parts):
            part = rows.filter(pa.compute.equal(rows["part"], p)).sort_by([("key", "ascending"), ("id", "ascending")])
            at += list(c._windows(shared, t)(iter(part.to_batches())))
    found = [r for b in at for r in b.to_pylist()]
    assert sorted(r["id"] for r in found) == list(ids)
    return {r["id"]: r["near"] for r in found}, placed


def test_neighbours_across_split_points_are_compared():
    x = np.random.default_rng(3).standard_normal((1200, 16)).astype(np.float32)
    near, placed = near_in_one_process(x, c.Settings(orderings=1, landmarks=600, block=60, partition_rows=300))
    where = placed[0]
    across = {tuple(sorted((where[i], where[j]))) for i, js in near.items() for j in js if where[i] != where[j]}
    assert {(0, 1), (1, 2), (2, 3)} <= across


def test_a_dense_region_larger_than_its_neighbour_blocks_is_searched_further():
    rng = np.random.default_rng(4)
    dense = rng.standard_normal(16) * 3 + 0.3 * rng.standard_normal((700, 16))
    x = np.concatenate([dense, rng.standard_normal((900, 16))]).astype(np.float32)
    u = c._unit(x)
    sims = u @ u.T
    np.fill_diagonal(sims, -9)
    best = np.argsort(-sims[:700], axis=1)[:, :10]

    def recall(reach):
        near, _ = near_in_one_process(x, c.Settings(orderings=1, landmarks=600, block=40, partition_rows=1600, reach=reach))
        return np.mean([len({f"c{j:04}" for j in best[i]} & set(near[f"c{i:04}"])) / 10 for i in range(700)])

    assert recall(20) >= 0.9 > recall(1)


def test_candidates_of_both_orderings_are_ranked_together():
    x = np.random.default_rng(5).standard_normal((500, 16)).astype(np.float32)
    u = c._unit(x)
    near, _ = near_in_one_process(x, c.Settings(landmarks=250, block=50, partition_rows=600))
    for i, js in near.items():
        cos = [float(u[int(i[1:])] @ u[int(j[1:])]) for j in js]
        assert len(set(js)) == len(js) == 10 and i not in js
        assert all(a >= b - 2e-6 for a, b in zip(cos, cos[1:], strict=False))


def test_more_orderings_beyond_a_million_rows():
    """Fewer landmarks for each region lose neighbours: at 2 million rows there are half of them."""
    at = [c.Settings.for_rows(n) for n in (0, 4_000, 790_000, 1_048_576, 1_048_577, 2_000_000, 10_000_000)]
    assert [s.orderings for s in at] == [2, 2, 2, 2, 3, 3, 6]
    assert at[-1].sample == 2 * at[-1].landmarks == 262_144


def test_third_ordering_makes_up_for_landmarks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((400, 64))[np.arange(4000) % 400] + 0.5 * rng.standard_normal((4000, 64))).astype(np.float32)
    rows = [(f"i{i:05}", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    far = unit @ unit.T
    np.fill_diagonal(far, -9)
    want = {rows[i][0]: {rows[j][0] for j in np.argsort(-far[i])[:10]} for i in range(len(rows))}
    monkeypatch.setattr(c, "MOST_LANDMARKS", 60, raising=False)
    s = c.Settings.for_rows(4000)
    few = {"landmarks": 60, "block": 64, "reach": 2, "sketch": 64, "partition_rows": 1000}
    recall = []
    for n in (2, s.orderings):
        got = {r.id: set(r.near) for r in c.nearest(df, dataclasses.replace(s, orderings=n, **few), 4000).collect()}
        assert len(got) == len(rows)
        recall.append(sum(len(want[k] & got[k]) for k in want) / (10 * len(rows)))
    assert s.orderings > 2 and recall[1] > recall[0] + 0.02
