"""The k most similar vectors of every vector, by shifted Hilbert orderings.

Each ordering projects the vectors to a few dimensions, shifts them and sorts them along a Hilbert curve. The projection
goes through landmarks of its own: a sample whose rows were moved to the centre of their region, so that vectors of one
region get nearly the same place. Landmarks are found in two steps (groups, then members of the nearest groups), so
placing a row costs the root of their number. Orderings are range-partitioned with split points from the sample. Within
a partition, blocks of the curve are compared with their neighbours; about one block beyond each split point comes
along from the neighbouring partition, to be compared with but not searched again. Blocks that lie wholly within one
dense region are compared with more blocks of that region, up to a fixed number.

The rows travel from ordering to ordering with their vector, as it is, and the best k found so far; so candidates of all
orderings are ranked by the cosine of the true vectors. The sample is bounded; every vector is ordered and searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamspark.operators.rows import current_rows
from loamspark.session import materialize, table

DIMENSIONS = 384
#: Cosines are told apart in steps of 1 / FAR, about the error of single precision; smaller ids come first beyond that.
FAR = 1 << 20
#: Rows of about 20 bytes that are broadcast; more are joined.
BROADCAST_KEYS = 1_000_000


#: Landmarks of an ordering; 256 bytes of each are broadcast.
MOST_LANDMARKS = 131_072


@dataclass(frozen=True)
class Settings:
    """Parameters of the index; for_rows() gives those for a collection's size.

    landmarks is their number in each ordering; the sample that is fitted on has twice as many rows. block is
    the number of neighbours on the curve that are compared at once, reach how many blocks to each side one of a dense
    region is compared with. At most k + 1 of a group of equal vectors are searched; the others get the group's result,
    which is exact.
    """

    k: int = 10
    orderings: int = 2
    landmarks: int = 8192
    sketch: int = 128
    dimensions: int = 4
    bits: int = 12
    nearest: int = 16
    probes: int = 12
    moves: int = 4
    soft: float = 6.0
    sharp: float = 20.0
    block: int = 384
    reach: int = 16
    dense: float = 0.5
    partition_rows: int = 12_288

    @property
    def copies(self) -> int:
        return self.k + 1

    @property
    def sample(self) -> int:
        return min(self.orderings, 2) * self.landmarks

    @staticmethod
    def for_rows(rows: int, k: int = 10) -> Settings:
        """An eighth of the rows are landmarks, MOST_LANDMARKS at most: the bound of the sample. Beyond that regions
        multiply and landmarks don't, which more orderings of smaller blocks make up for: a third one, and another for each
        doubling of the rows.

        Blocks grow with the root of the rows and probes with the root of the landmarks, so that recall holds as regions
        multiply: comparing is 2.9 % of all pairs at 79,000 rows, 0.9 % at ten times as many.
        """
        landmarks = min(max(512, rows // 8), MOST_LANDMARKS)
        orderings = 2 + (max(0, rows - 1) // (8 * MOST_LANDMARKS)).bit_length()
        return Settings(k=k, orderings=orderings, landmarks=landmarks, probes=max(12, int(landmarks**0.5) // 8), block=max(384, int(2.6 * rows**0.5) // orderings), partition_rows=max(12_288, rows // 2048))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer cells (rows, dimensions), each below 2 ** bits.

    Gray-code transform after J. Skilling, "Programming the Hilbert curve" (2004), over whole columns.
    """
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _rows_to_one(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


class Landmarks:
    """Sketches of landmarks, and for each the centre of its region."""

    def __init__(self, marks: np.ndarray, s: Settings, rng: np.random.Generator) -> None:
        self.s, self.marks, self.packed = s, marks, None
        groups = max(1, int(len(marks) ** 0.5))
        self.heads = marks[rng.permutation(len(marks))[:groups]].copy()
        for _ in range(2):
            sums, own = np.zeros_like(self.heads), self._nearest_head(marks)
            np.add.at(sums, own, marks)
            self.heads = np.where(np.bincount(own, minlength=groups)[:, None] > 0, _rows_to_one(sums), self.heads)
        own = self._nearest_head(marks)
        order = np.argsort(own, kind="stable")
        self.marks, self.starts = marks[order], np.searchsorted(own[order], np.arange(groups + 1))
        self.centres = self.marks

    def _nearest_head(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.argmax(x[i : i + 16_384] @ self.heads.T, 1) for i in range(0, len(x), 16_384)])

    def moved(self, lo: int, hi: int) -> np.ndarray:
        """The landmarks from lo to hi - 1, moved to the centres of their regions."""
        self._open()
        x = self.marks[lo:hi]
        for _ in range(self.s.moves):
            x = self._mix(*self._near(x), self.s.soft, self.marks)
        return x

    def _near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(landmark, similarity) of the nearest landmarks of each row, among those of the nearest groups."""
        n, k = len(x), min(self.s.nearest, len(self.marks))
        probes = min(self.s.probes, len(self.heads))
        near = np.argpartition(-(x @ self.heads.T), probes - 1, axis=1)[:, :probes].ravel()
        order = np.argsort(near, kind="stable")
        rows, cuts = np.repeat(np.arange(n), probes)[order], np.searchsorted(near[order], np.arange(len(self.heads) + 1))
        which, far = np.zeros((n, k), np.int64), np.full((n, k), 9, np.float32)
        for g in range(len(self.heads)):
            r, (lo, hi) = rows[cuts[g] : cuts[g + 1]], self.starts[g : g + 2]
            if not len(r) or lo == hi:
                continue
            d = -(x[r] @ self.marks[lo:hi].T)
            some = np.argpartition(d, k - 1, axis=1)[:, :k] if hi - lo > k else np.broadcast_to(np.arange(hi - lo), d.shape)
            d = np.concatenate([far[r], np.take_along_axis(d, some, 1)], 1)
            i = np.concatenate([which[r], some + lo], 1)
            best = np.argpartition(d, k - 1, axis=1)[:, :k]
            far[r], which[r] = np.take_along_axis(d, best, 1), np.take_along_axis(i, best, 1)
        return which, -far

    def pack(self) -> None:
        """Keep sketches as signed bytes until the next use: they only say where to look, vectors are never rounded."""
        if self.packed is None:
            self.packed = {}
            for name in ("marks", "centres", "heads"):
                whole = getattr(self, name)
                scale = max(float(np.abs(whole).max(initial=0)), 1e-30) / 127
                self.packed[name] = (np.rint(whole / scale).astype(np.int8), scale)
        for name in self.packed:
            setattr(self, name, None)

    def _open(self) -> None:
        if self.marks is None:
            for name, (whole, scale) in self.packed.items():
                setattr(self, name, _rows_to_one(whole.astype(np.float32) * np.float32(scale)))

    def __getstate__(self) -> dict:
        """Only the packed form is sent; the owner's arrays stay as they are."""
        sent = Landmarks.__new__(Landmarks)
        sent.__dict__.update(self.__dict__)
        sent.pack()
        return sent.__dict__

    @staticmethod
    def _mix(which: np.ndarray, near: np.ndarray, sharp: float, of: np.ndarray) -> np.ndarray:
        w = np.exp(sharp * (near - near.max(1, keepdims=True)))
        return _rows_to_one(np.matmul(w[:, None, :], of[which])[:, 0, :])

    def place(self, x: np.ndarray) -> np.ndarray:
        """Centre of the region of each sketch."""
        self._open()
        return self._mix(*self._near(x), self.s.sharp, self.centres)


class Orderings:
    """Landmarks, shifts and split points of all orderings, fitted on a bounded sample of sketches."""

    def __init__(self, sample: np.ndarray, rows: int, s: Settings, move=lambda marks: marks.moved(0, len(marks.marks))) -> None:
        """move: gives all landmarks, moved to their centres."""
        self.s, self.mean = s, sample.mean(0, dtype=np.float64).astype(np.float32)
        seen = lambda rows: _rows_to_one(sample[rows].astype(np.float32) - self.mean)
        self.parts = max(1, -(-rows // s.partition_rows))
        self.maps, self.splits, self.band = [], [], []
        for t in range(s.orderings):
            rng = np.random.default_rng(t)
            order = rng.permutation(len(sample))
            marks = Landmarks(seen(order[: s.landmarks]), s, rng)
            marks.centres = move(marks)
            y = marks.place(seen(order[::-1][:32_768])) @ (onto := rng.standard_normal((sample.shape[1], s.dimensions)).astype(np.float32))
            edges = np.quantile(y, np.linspace(0, 1, 257)[1:-1], axis=0).astype(np.float32)
            self.maps.append((marks, onto, edges, rng.random(s.dimensions)))
            keys = np.sort(self._keys(y, t))
            at = (np.arange(1, self.parts) * len(keys)) // self.parts
            self.splits.append(keys[at])
            # keys about one block before and after each split point
            block = max(1, -(-s.block * len(keys) // max(rows, 1)))
            self.band.append((keys[np.maximum(at - block, 0)], keys[np.minimum(at + block, len(keys) - 1)]))
            marks.pack()

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Sketches of unit vectors, seen from the sample's mean."""
        return _rows_to_one(x @ _projection(x.shape[1], self.s.sketch) - self.mean)

    def _keys(self, y: np.ndarray, t: int) -> np.ndarray:
        """Curve place of projected rows: each dimension is cut at the sample's quantiles, and shifted."""
        _, _, edges, shift = self.maps[t]
        size = 1 << self.s.bits
        cells = np.empty(y.shape, np.int64)
        for i in range(y.shape[1]):
            e = edges[:, i]
            j = np.searchsorted(e, y[:, i])
            lo, hi = e[np.maximum(j - 1, 0)], e[np.minimum(j, len(e) - 1)]
            within = np.clip(np.where(hi > lo, (y[:, i] - lo) / np.where(hi > lo, hi - lo, 1), 0.5), 0, 0.999)
            cells[:, i] = ((j + within) / 256 + shift[i]) / 2 * size
        return hilbert_keys(np.clip(cells, 0, size - 1), self.s.bits)

    def place(self, sketch: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(partition, key) of centred sketches in ordering t."""
        marks, onto, _, _ = self.maps[t]
        if marks.marks is None:
            for other, *_ in self.maps:  # one ordering's landmarks at a time are in memory whole
                other.pack()
        keys = self._keys(marks.place(sketch) @ onto, t)
        return np.searchsorted(self.splits[t], keys, "right"), keys

    def guests(self, at: np.ndarray, keys: np.ndarray, t: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, partition) of those placed rows that lie within a block of a split point, for the partition beyond."""
        if self.parts == 1:
            return
        low, high = self.band[t]
        up = np.nonzero((at < self.parts - 1) & (keys >= low[np.minimum(at, self.parts - 2)]))[0]
        yield up, at[up] + 1
        down = np.nonzero((at > 0) & (keys < high[np.maximum(at - 1, 0)]))[0]
        yield down, at[down] - 1


def _projection(dimensions: int, onto: int) -> np.ndarray:
    """Random directions, the same in every process; scaled so that similarities keep their size."""
    x = np.random.default_rng(384).standard_normal((dimensions, onto)) / onto**0.5
    return x.astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def _usable(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        n = np.linalg.norm(x.astype(np.float64), axis=1)
    return np.isfinite(n) & (n > 0)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)


def _packed(x: np.ndarray) -> pa.Array:
    """Vectors as they are: the bytes of equal weight together, compressed."""
    press = zstandard.ZstdCompressor(level=1).compress
    return pa.array([press(r.tobytes()) for r in np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1, 4).transpose(0, 2, 1))], pa.binary())


def _unpacked(column: pa.Array) -> np.ndarray:
    press = zstandard.ZstdDecompressor().decompress
    flat = np.frombuffer(b"".join(map(press, column.to_pylist())), np.uint8).reshape(len(column), 4, -1)
    return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(np.float32).reshape(len(column), -1)


def _sketches(drawn: int, size: int):
    """(id, ga, gb, sketch): 128 bits of hash of each usable vector; the sketch of those that are drawn as a sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b["embedding"])
            ok = np.nonzero(_usable(x))[0]
            x, ids = x[ok], b["id"].take(pa.array(ok))
            group = np.frombuffer(b"".join(xxhash.xxh128_digest(r.tobytes()) for r in x), np.int64).reshape(-1, 2)
            chosen = np.nonzero(group[:, 0] % (1 << 20) < drawn)[0]
            flat = (_unit(x[chosen]) @ _projection(x.shape[1], size)).astype(np.float16)
            sketches: list[bytes | None] = [None] * len(x)
            for i, r in zip(chosen, flat, strict=True):
                sketches[i] = r.tobytes()
            yield pa.record_batch([ids, pa.array(group[:, 0]), pa.array(group[:, 1]), pa.array(sketches, pa.binary())], ["id", "ga", "gb", "sketch"])

    return run


_TRAVELLING = "id string, vector binary, part int, key long, guest boolean, ids array<string>, far array<int>"


def _placed(o: Orderings, t: int, ids: pa.Array, vectors: pa.Array, unit: np.ndarray, near: pa.Array, far: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows with their place in ordering t; those near a split point once more as guests beyond it, without candidates."""
    where, keys = o.place(o.centred(unit), t)
    names = [x.strip().split()[0] for x in _TRAVELLING.split(",")]
    yield pa.record_batch([ids, vectors, pa.array(where, pa.int32()), pa.array(keys, pa.int64()), pa.array(np.zeros(len(ids), bool)), near, far], names)
    for rows, to in o.guests(where, keys, t):
        some = pa.array(rows)
        none = [pa.nulls(len(rows), x) for x in (pa.list_(pa.string()), pa.list_(pa.int32()))]
        yield pa.record_batch([ids.take(some), vectors.take(some), pa.array(to, pa.int32()), pa.array(keys[rows], pa.int64()), pa.array(np.ones(len(rows), bool)), *none], names)


def _first(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o: Orderings = shared.value
        for b in batches:
            x = _matrix(b["embedding"])
            ok = np.nonzero(_usable(x))[0]
            for i in range(0, len(ok), 4096):
                some = ok[i : i + 4096]
                none = [pa.nulls(len(some), x) for x in (pa.list_(pa.string()), pa.list_(pa.int32()))]
                yield from _placed(o, 0, b["id"].take(pa.array(some)).cast(pa.string()), _packed(x[some]), _unit(x[some]), *none)

    return run


class _Block:
    """Neighbours on the curve: what they carry, unit vectors, guests, and the middle of their sketches."""

    def __init__(self, rows: pa.RecordBatch, o: Orderings) -> None:
        self.rows = rows
        self.ids = np.array(rows["id"].to_pylist(), str)
        self.unit = _unit(_unpacked(rows["vector"]))
        self.own = np.nonzero(~rows["guest"].to_numpy(zero_copy_only=False))[0]
        self.middle = o.centred(self.unit).mean(0)
        self.dense = float(np.linalg.norm(self.middle))


def _blocks(batches: Iterator[pa.RecordBatch], o: Orderings) -> Iterator[_Block]:
    held, size = [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(b.num_rows - at, o.s.block - size)
            held.append(b.slice(at, n))
            at, size = at + n, size + n
            if size == o.s.block:
                yield _Block(pa.Table.from_batches(held).combine_chunks().to_batches()[0], o)
                held, size = [], 0
    if size:
        yield _Block(pa.Table.from_batches(held).combine_chunks().to_batches()[0], o)


def _best(s: Settings, here: _Block, others: list[_Block]) -> tuple[pa.Array, pa.Array]:
    """(ids, far) of the best k of each own row of a block: among the blocks given and what the row carries."""
    ids = np.concatenate([here.ids, *[z.ids for z in others]])
    x = np.concatenate([here.unit, *[z.unit for z in others]])
    n, own = len(here.own), here.own
    far = -(here.unit[own] @ x.T)
    far[np.arange(n), own] = np.inf
    take = min(s.k, len(ids) - 1)
    row, near, d = np.zeros(0, np.int64), np.zeros(0, ids.dtype), np.zeros(0, np.int64)
    if take:
        last = np.partition(far, take - 1, axis=1)[:, take - 1 : take]
        row, col = np.nonzero(far <= last + 2 / FAR)
        near, d = ids[col], np.rint(far[row, col] * FAR).astype(np.int64)
    lists, before = here.rows["ids"].take(pa.array(own)), here.rows["far"].take(pa.array(own))
    sizes = np.array([len(v) if v is not None else 0 for v in before.to_pylist()], np.int64)
    if sizes.sum():
        row = np.concatenate([row, np.repeat(np.arange(n), sizes)])
        near = np.concatenate([near, np.array(lists.flatten().to_pylist(), str)])
        d = np.concatenate([d, before.flatten().to_numpy().astype(np.int64)])
        # a candidate that both know counts once
        _, code = np.unique(near, return_inverse=True)
        _, once = np.unique(row * (len(near) + 1) + code, return_index=True)
        row, near, d = row[once], near[once], d[once]
    order = np.lexsort((near, d, row))
    row, near, d = row[order], near[order], d[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < s.k
    row, near, d = row[keep], near[keep], d[keep]
    ends = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(near, pa.string())), pa.ListArray.from_arrays(ends, pa.array(d.astype(np.int32)))


def _windows(shared, t: int):
    """The best of each row of a partition of ordering t, sorted by key; placed in the next ordering if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o: Orderings = shared.value
        s, held, first = o.s, [], 0  # held[j] is block first + j

        def around(i: int) -> list[_Block]:
            here, found = held[i - first], []
            for step in (-1, 1):
                for j in range(1, s.reach + 1):
                    at = i + step * j - first
                    if not 0 <= at < len(held):
                        break
                    if j > 1 and not (here.dense >= s.dense and float(here.middle @ held[at].middle) >= s.dense * here.dense * held[at].dense and held[at].dense >= s.dense):
                        break
                    found.append(held[at])
            return found

        def done(i: int) -> Iterator[pa.RecordBatch]:
            here = held[i - first]
            if not len(here.own):
                return
            near, far = _best(s, here, around(i))
            own = pa.array(here.own)
            if t + 1 == s.orderings:
                yield pa.record_batch([here.rows["id"].take(own), near], ["id", "near"])
            else:
                yield from _placed(o, t + 1, here.rows["id"].take(own), here.rows["vector"].take(own), here.unit[here.own], near, far)

        i = 0
        for b in _blocks(batches, o):
            held.append(b)
            if len(held) + first > i + s.reach:
                yield from done(i)
                i += 1
                if i - first > s.reach:
                    held, first = held[1:], first + 1
        for j in range(i, first + len(held)):
            yield from done(j)

    return run


def _moved_by_tasks(spark):
    """Landmarks.moved() of all landmarks, by tasks over ranges of them; about 500 bytes a landmark come back."""

    def move(marks: Landmarks) -> np.ndarray:
        shared, n, step = spark.sparkContext.broadcast(marks), len(marks.marks), 2048

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in b["id"].to_pylist():
                    yield pa.record_batch([pa.array([lo]), pa.array([shared.value.moved(lo, lo + step).tobytes()], pa.binary())], ["lo", "x"])

        parts = spark.range(0, n, step, max(1, n // step)).mapInArrow(run, "lo long, x binary").collect()  # bounded by s.landmarks
        shared.destroy()
        parts.sort(key=lambda r: r.lo)
        return np.frombuffer(b"".join(bytes(r.x) for r in parts), np.float32).reshape(n, -1)

    return move


def usable_vectors(df: DataFrame, key: str, vector: str, order: str, dimensions: int) -> DataFrame:
    """(id, embedding) of the current row of each key; null and short vectors and those with a null are left out.

    Only keys with several rows are shuffled. Non-finite and zero vectors are left out by nearest().
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), order, F.when(F.size(vector) == dimensions, F.col(vector)).alias("embedding"))
    several = materialize(rows.groupBy("id").count().where("count > 1").select("id"), "several")
    if several.count() <= BROADCAST_KEYS:
        several = F.broadcast(several)
    one = rows.join(several, "id", "left_anti").select("id", "embedding")
    rows = one.unionByName(current_rows(rows.join(several, "id", "left_semi"), "id", order, ["embedding"]))
    return rows.where("embedding IS NOT NULL AND NOT exists(embedding, v -> v IS NULL)")


def nearest(vectors: DataFrame, s: Settings | None = None, rows: int | None = None) -> DataFrame:
    """(id, near): for each row of usable_vectors() its k most cosine-similar others, ties by smaller id.

    near is an array of ids, the most similar first. ids must be unique; vectors with a value that isn't finite and zero
    vectors are left out. Equal vectors form a group: its k + 1 smallest ids are searched, which is all that any row can
    have among its nearest, and the rest take the group's first ids. An empty or one-row table gives no neighbours. rows
    is about how many there are.
    """
    spark = vectors.sparkSession
    rows = vectors.count() if rows is None else rows
    s = Settings.for_rows(rows) if s is None else s
    drawn = int((1 << 20) * min(1.0, 1.1 * s.sample / max(rows, 1)))
    hashed = materialize(vectors.mapInArrow(_sketches(drawn, s.sketch), "id string, ga long, gb long, sketch binary"), "vectors")
    full = materialize(hashed.groupBy("ga", "gb").count().where(F.col("count") > s.copies).select("ga", "gb"), "full-groups")
    if full.count() <= BROADCAST_KEYS:
        full = F.broadcast(full)
    place = F.row_number().over(Window.partitionBy("ga", "gb").orderBy("id"))
    # a window group limit keeps k + 1 rows of a group in each task before the shuffle; the groups are those of `full`
    heads = hashed.select("id", "ga", "gb").join(full, ["ga", "gb"], "left_semi").withColumn("place", place).where(F.col("place") <= s.copies)
    heads = heads.groupBy("ga", "gb").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    surplus = materialize(hashed.select("id", "ga", "gb").join(full, ["ga", "gb"], "left_semi").join(heads, ["ga", "gb"]).where(~F.array_contains("ids", F.col("id"))).select("id", "ids"), "surplus")
    copies = F.broadcast(surplus.select("id")) if surplus.count() <= BROADCAST_KEYS else surplus.select("id")

    sample = hashed.where("sketch IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(s.sample).select("sketch").collect()  # bounded by s.sample
    if len(sample) < 2:
        return spark.createDataFrame([], "id string, near array<string>")
    sketches = np.frombuffer(b"".join(bytes(r.sketch) for r in sample), np.float16).reshape(len(sample), -1)
    del sample
    shared = spark.sparkContext.broadcast(Orderings(sketches, rows, s, _moved_by_tasks(spark)))
    at = vectors.join(copies, "id", "left_anti").mapInArrow(_first(shared), _TRAVELLING)
    for t in range(s.orderings):
        ranged = at.repartitionById(shared.value.parts, F.col("part")).sortWithinPartitions("key", "id")
        at = ranged.mapInArrow(_windows(shared, t), "id string, near array<string>" if t + 1 == s.orderings else _TRAVELLING)
    return at.unionByName(surplus.select("id", F.slice("ids", 1, s.k).alias("near")))


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """(chunk_id_a, chunk_id_b), a < b: each pair of which one is among the other's nearest, once."""
    pairs = near.select("id", F.explode("near").alias("other"))
    return pairs.select(F.least("id", "other").alias("chunk_id_a"), F.greatest("id", "other").alias("chunk_id_b")).distinct()


def similar_chunks(spark, sf_dir: str) -> DataFrame:
    """neighbour_pairs of the current usable embeddings of all code chunks."""
    embeddings = table(spark, sf_dir, "code_chunk_embeddings")
    return neighbour_pairs(nearest(usable_vectors(embeddings, "chunk_id", "embedding", "updated_at", DIMENSIONS), rows=embeddings.count()))
