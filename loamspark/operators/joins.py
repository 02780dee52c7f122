"""Join shapes that Spark has no operator for, without a pair per two rows of a group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamspark.session import materialize


def conflicts(df: DataFrame, slot: Sequence[str], value: str, key: str) -> DataFrame:
    """(key, slot, value_class, conflicting): rows of slots that hold several values, and how many rows disagree.

    Instead of all pairs, rows with equal values form a class named by its smallest key; a row conflicts with every
    row of its slot outside its class. Null is a value of its own. Counts are combined map-side and joined back, so a
    slot with a third of all rows is never brought together; the join on it is left to adaptive skew handling.
    """
    val = F.coalesce(F.concat(F.lit("="), F.col(value)), F.lit("null")).alias("_v")
    rows = df.select(key, *slot, val)
    classes = rows.groupBy(*slot, "_v").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("value_class"))
    totals = classes.groupBy(*slot).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("values")).where("values > 1")
    on = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in slot]
    open_ = classes.alias("c").join(totals.alias("t"), on("c", "t")).select("c.*", (F.col("total") - F.col("n")).alias("conflicting"))
    match = [*on("r", "o"), F.col("r._v") == F.col("o._v")]
    return rows.alias("r").join(open_.alias("o"), match).select(f"r.{key}", *[f"r.{c}" for c in slot], "value_class", "conflicting")


def point_in_range(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, start: str, end: str, point_id: str, order: Sequence[Column], bin_size: int) -> DataFrame:
    """Each point with the first range, by order, of its key group that covers it; points without one are left out.

    Ranges are spread over fixed bins, so the join has an equi-key however many ranges a group holds.
    """
    lo, hi = (F.floor(F.col(c) / bin_size) for c in (start, end))
    spread = ranges.where(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(lo, hi)))
    p = points.withColumn("_bin", F.floor(F.col(at) / bin_size))
    met = p.join(spread, [*keys, "_bin"]).where(F.col(at).between(F.col(start), F.col(end)))
    w = Window.partitionBy(point_id).orderBy(*order)
    return met.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_bin")


def as_of_rows(df: DataFrame, keys: Sequence[str], at: str, instant: Column, tie: str) -> DataFrame:
    """Of each key the newest row at or before instant; the maximum is combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(F.col(at).alias("_at"), F.col(tie).alias("_tie"), *[F.col(c) for c in rest])).alias("b")
    return df.where(F.col(at) <= instant).groupBy(*keys).agg(best).select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def near_in_time(df: DataFrame, group: str, at: str, key: str, seconds: int) -> DataFrame:
    """(key, before): how many rows of the same group lie within `seconds` before each row.

    A range frame over the ordered group counts them; no pair is formed.
    """
    w = Window.partitionBy(group).orderBy(F.unix_seconds(at)).rangeBetween(-seconds, Window.currentRow)
    return df.where(F.col(at).isNotNull()).select(key, group, (F.count(F.lit(1)).over(w) - 1).alias("before"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): keys added, removed, or changed in value."""
    a, b = old.select(key, F.col(value).alias("_a"), F.lit(True).alias("_old")), new.select(key, F.col(value).alias("_b"), F.lit(True).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")


def opposite_links(df: DataFrame, key: str, group: str, text: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(key, links): how many rows of the same group hold the opposite word of a pair that a row holds.

    Rows with the same words form a class; only classes of a group meet (at most a few hundred), never rows. A row isn't
    its own partner. Null groups and texts have no partners.
    """
    mask = lambda side: sum((F.when(F.contains(F.lower(text), F.lit(p[side])), 1 << i).otherwise(0) for i, p in enumerate(pairs)), F.lit(0))
    rows = df.where(F.col(group).isNotNull() & F.col(text).isNotNull()).select(key, group, mask(0).alias("a"), mask(1).alias("b")).where("a <> 0 OR b <> 0")
    classes = rows.groupBy(group, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    meet = (F.col("x.a").bitwiseAND(F.col("y.b")) != 0) | (F.col("x.b").bitwiseAND(F.col("y.a")) != 0)
    itself = (F.col("x.a") == F.col("y.a")) & (F.col("x.b") == F.col("y.b"))
    links = classes.alias("x").join(classes.alias("y"), (F.col(f"x.{group}") == F.col(f"y.{group}")) & meet)
    links = links.groupBy(f"x.{group}", "x.a", "x.b").agg(F.sum(F.col("y.n") - F.when(itself, 1).otherwise(0)).alias("links")).where("links > 0")
    return rows.join(links, [group, "a", "b"]).select(key, "links")


def disputed(df: DataFrame, slot: Sequence[str], who: str, value: str, key: str) -> DataFrame:
    """(key, links): with how many rows of its slot a row differs in both `who` and `value` (null is a value).

    Counted from the sizes of a slot, of its agents, values and their pairs; no two rows meet. Null slots are left out.
    """
    same = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    rows = df.where(" AND ".join(f"{c} IS NOT NULL" for c in slot)).select(key, *slot, same(who).alias("_w"), same(value).alias("_v"))
    cells = rows.groupBy(*slot, "_w", "_v").agg(F.count(F.lit(1)).alias("wv"))
    by = lambda cols, name: cells.groupBy(*slot, *cols).agg(F.sum("wv").alias(name))
    known = cells.join(by([], "n"), list(slot)).join(by(["_w"], "w"), [*slot, "_w"]).join(by(["_v"], "v"), [*slot, "_v"])
    open_ = known.select(*slot, "_w", "_v", (F.col("n") - F.col("w") - F.col("v") + F.col("wv")).alias("links")).where("links > 0")
    return rows.join(open_, [*slot, "_w", "_v"]).select(key, "links")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of a text, each padded by two spaces before and one behind."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of_word)))


#: Texts of a group that are compared at once with as many; groups with more are split into tiles.
TILE = 32_768
#: Words of 64 bits of a text's map: for each bit, whether an odd number of its trigrams fall on it.
MAP_WORDS = 4
#: Ids that are broadcast; more are joined.
BROADCAST_IDS = 1_000_000
_AT_ONCE = 1 << 21


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gid, tid, s, m0 ..) of (gid, tid, g): number and map of the trigrams' hashes."""
    for b in batches:
        lists, n = b["g"], pa.compute.list_value_length(b["g"]).to_numpy().astype(np.int32)
        h = lists.flatten().to_numpy().view(np.uint64)
        row, word = np.repeat(np.arange(len(n)), n), (h >> np.uint64(6)) % np.uint64(MAP_WORDS)
        maps = np.zeros((len(n), MAP_WORDS), np.uint64)
        np.bitwise_xor.at(maps, (row, word.astype(np.int64)), np.uint64(1) << (h & np.uint64(63)))
        yield pa.record_batch([b["gid"], b["tid"], pa.array(n), *[pa.array(maps[:, i].view(np.int64)) for i in range(MAP_WORDS)]], ["gid", "tid", "s", *[f"m{i}" for i in range(MAP_WORDS)]])


def _near(tile: list[np.ndarray], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b): pairs of a tile's texts that sizes and maps allow to be alike, once each. side 0 meets side 1, side 2 itself.

    Of two texts that share more than `percent` % of n trigrams, fewer than (100 - percent) % of n are in one only, and
    each of these turns one bit of the map at most.
    """
    tid, side, s, *maps = tile
    order = np.argsort(s, kind="stable")
    tid, side, s, maps = tid[order], side[order], s[order].astype(np.int64), [m[order].view(np.uint64) for m in maps]
    alone = side[0] == 2
    left, right = (np.arange(len(s)),) * 2 if alone else (np.nonzero(side == 0)[0], np.nonzero(side == 1)[0])
    i = 0
    while i < len(left):
        # sizes rise: the rows of `right` that a left one may match are a window
        lo = i + 1 if alone else int(np.searchsorted(s[right], s[left[i]] * percent / 100, "right"))
        to = min(len(left), i + max(1, _AT_ONCE // max(1, len(right) - lo)), i + 1024)
        x = left[i:to]
        hi = int(np.searchsorted(s[right], s[x[-1]] * 100 / percent, "left"))
        y = right[lo:hi]
        apart = np.bitwise_count(maps[0][x][:, None] ^ maps[0][y]).astype(np.int16) + np.bitwise_count(maps[1][x][:, None] ^ maps[1][y])
        r, c = np.nonzero(apart * np.int64(100 + percent) < (s[x][:, None] + s[y]) * (100 - percent))
        r, c = x[r], y[c]
        if alone:
            r, c = r[r < c], c[r < c]
        apart = sum((np.bitwise_count(m[r] ^ m[c]).astype(np.int64) for m in maps), np.zeros(len(r), np.int64))
        keep = (apart * (100 + percent) < (s[r] + s[c]) * (100 - percent)) & (s[r] * 100 > s[c] * percent) & (s[c] * 100 > s[r] * percent)
        if keep.any():
            yield pa.record_batch([pa.array(tid[r[keep]]), pa.array(tid[c[keep]])], ["a", "b"])
        i = to


def _near_pairs(percent: int):
    """_near() of each tile of rows sorted by (gid, tile); a tile has about 2 * TILE rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["gid", "tile", "tid", "side", "s", *[f"m{i}" for i in range(MAP_WORDS)]], None

        def tiles(z: list[np.ndarray], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo > 1:
                    yield from _near([x[lo:hi] for x in z[2:]], percent)

        for b in batches:
            if not b.num_rows:
                continue
            now = [b[x].to_numpy() for x in names]
            held = now if held is None else [np.concatenate(z) for z in zip(held, now, strict=True)]
            cuts = np.nonzero(np.append(True, (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])))[0]
            yield from tiles(held, cuts)
            held = [z[cuts[-1] :] for z in held]
        if held is not None:
            yield from tiles(held, np.array([0, len(held[0])]))

    return run


def similar_texts(df: DataFrame, key: str, group: str, text: str, value: str, percent: int) -> DataFrame:
    """(key, links): with how many rows of its group a row's text shares more than `percent` % of all trigrams, while
    their values differ (null is a value).

    The distinct texts of a group are compared by sizes and maps of their trigrams, which lose no similar pair; large
    groups are split into tiles in which each pair meets once. What is left is compared exactly. A row's links are the
    rows of its own and of similar texts, less those of them with its value; both are sums over distinct texts.
    """
    held = df.where(F.col(group).isNotNull() & F.col(text).isNotNull()).select(key, F.col(group).alias("_g"), F.lower(text).alias("_t"), F.coalesce(F.concat(F.lit("="), F.col(value)), F.lit("null")).alias("_v"))
    held = materialize(held.withColumn("tid", F.xxhash64("_g", "_t")), "texts-held")
    grams = F.transform(trigrams(F.col("_t")), lambda x: F.xxhash64(x)).alias("g")
    texts = held.groupBy("tid").agg(F.first("_g").alias("_g"), F.first("_t").alias("_t"))
    sizes = ", ".join(f"m{i} long" for i in range(MAP_WORDS))
    mapped = texts.select(F.xxhash64("_g").alias("gid"), "tid", grams).where("size(g) > 0")
    mapped = materialize(mapped.mapInArrow(_mapped, f"gid long, tid long, s int, {sizes}"), "texts-mapped")
    groups = mapped.groupBy("gid").count().where("count > 1").select("gid", F.ceil(F.col("count") / F.lit(TILE)).cast("int").alias("parts"))
    parted = mapped.join(groups, "gid").withColumn("p", F.pmod(F.xxhash64("tid", F.lit(1)), F.col("parts")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct((F.least("p", j) * F.col("parts") + F.greatest("p", j)).alias("tile"), F.when(F.col("p") == j, 2).when(F.col("p") < j, 0).otherwise(1).alias("side")))
    tiled = parted.withColumn("o", F.explode(others)).select("gid", "o.tile", "tid", "o.side", "s", *[f"m{i}" for i in range(MAP_WORDS)])
    near = materialize(tiled.repartition("gid", "tile").sortWithinPartitions("gid", "tile").mapInArrow(_near_pairs(percent), "a long, b long"), "texts-near")
    asked = materialize(near.select(F.col("a").alias("tid")).unionByName(near.select(F.col("b").alias("tid"))).distinct(), "texts-asked")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked
    lists = materialize(held.join(asked, "tid", "left_semi").groupBy("tid").agg(F.first("_g").alias("_g"), F.first("_t").alias("_t")).select("tid", "_g", grams), "texts-grams")
    of = lambda n: lists.select(F.col("tid").alias(n), F.struct("_g", "g").alias(f"{n}_of"))
    common = F.size(F.array_intersect("a_of.g", "b_of.g"))
    alike = (F.col("a_of._g") == F.col("b_of._g")) & (common * 100 > (F.size("a_of.g") + F.size("b_of.g") - common) * percent)
    pairs = near.join(of("a"), "a").join(of("b"), "b").where(alike).select("a", "b")
    pairs = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "texts-alike")

    # a text with any trigrams is similar to itself
    cells = materialize(held.join(mapped.select("tid"), "tid", "left_semi").groupBy("tid", "_v").agg(F.count(F.lit(1)).alias("n")), "texts-values")
    reach = pairs.unionByName(mapped.select(F.col("tid").alias("a"), F.col("tid").alias("b")))
    met = reach.join(cells.withColumnRenamed("tid", "b"), "b").groupBy("a", "_v").agg(F.sum("n").alias("n"))
    totals = met.groupBy("a").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("values")).where("values > 1")
    open_ = met.join(totals, "a").select(F.col("a").alias("tid"), "_v", (F.col("all") - F.col("n")).alias("links"))
    return held.join(materialize(open_, "texts-links"), ["tid", "_v"]).select(key, "links")
