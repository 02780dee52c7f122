"""History of changing attributes, kept by Merkle comparison of snapshots.

A claim says that a slot (entity, property) had a value from a moment on. Each snapshot of the claims gets a hash
tree: slots fall into a fixed number of leaves, a leaf's digest is an order-free hash of its claims, an inner node's
digest hashes those of its children. Comparing two snapshots descends from the root into differing branches only;
claims are read and compared for the changed leaves alone, and the new versions are appended to the log.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamspark.functions.text import fold, not_blank, slot_key
from loamspark.operators.rows import current_struct
from loamspark.session import materialize

SLOT = ["entity", "property"]
VERSION = [*SLOT, "value", "valid_from_us", "valid_to_us"]
#: Children of an inner node, and levels below the root: 512 ** 2 leaves, however large the data.
FANOUT, LEVELS = 512, 2
#: Parts of the time axis with about as many claims each; a slot's claims of one part are ordered in one task.
TIME_PARTS = 64


def leaf_of(*slot: str) -> Column:
    return F.pmod(F.xxhash64(*[F.col(x) for x in slot]), F.lit(FANOUT**LEVELS)).cast("int")


def claims_from(items: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Claims (leaf, entity, property, t, value, old_value) of items as they are now, and as they were at as_of.

    An item's current row is the one with the greatest updated_at; it makes a claim if entity, property and value
    are not blank and first_seen is not null. Of a slot's claims with equal first_seen that of the smallest id
    holds. value is null where only the older snapshot has the claim, old_value where only the newer one has it.
    """
    fields = ["entity", "property", "value", "first_seen"]
    row = current_struct("updated_at", fields)
    now, then = F.max(row).alias("now"), F.max(F.when(F.col("updated_at") <= as_of, row) if as_of is not None else F.lit(None).cast("struct<_has:boolean,_order:timestamp,entity:string,property:string,value:string,first_seen:timestamp>")).alias("then")
    ids = items.where(F.col("id").isNotNull()).select("id", "updated_at", *fields).groupBy("id").agg(now, then)
    sides = ids.select("id", F.explode(F.array(F.struct(F.lit(1).alias("new"), F.col("now").alias("r")), F.struct(F.lit(0).alias("new"), F.col("then").alias("r")))).alias("s")).select("id", "s.new", "s.r.*")
    usable = sides.where(not_blank(F.col("entity")) & not_blank(F.col("property")) & not_blank(F.col("value")) & F.col("first_seen").isNotNull())
    keyed = usable.select("id", "new", slot_key(F.col("entity")).alias("entity"), slot_key(F.col("property")).alias("property"), F.unix_micros(F.col("first_seen").cast("timestamp")).alias("t"), fold(F.col("value")).alias("v"))
    first = lambda side: F.min(F.when(F.col("new") == side, F.struct("id", "v"))).getField("v")
    claims = keyed.groupBy(*SLOT, "t").agg(first(1).alias("value"), first(0).alias("old_value"))
    return claims.withColumn("leaf", leaf_of(*SLOT))


def leaf_digests(claims: DataFrame) -> DataFrame:
    """(node, was, is): each leaf's digest in the older and the newer snapshot; at most FANOUT ** LEVELS rows.

    A digest is the xor of 128-bit claim hashes, so order is free, and their number; null if the leaf has no claim.
    """

    def digest(value: str) -> Column:
        here, parts = F.col(value).isNotNull(), [F.col(x) for x in (*SLOT, "t", value)]
        xor = [F.bit_xor(F.when(here, F.xxhash64(*salt, *parts))) for salt in ([], [F.lit("second")])]
        return F.concat_ws("/", *xor, F.count_if(here))

    return claims.groupBy(F.col("leaf").alias("node")).agg(digest("old_value").alias("was"), digest("value").alias("is"))


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels of both snapshots' hash trees from the root down to the leaves, each (node, was, is)."""
    levels = [leaves]
    for _ in range(LEVELS):
        kids = levels[0].groupBy((F.col("node") / FANOUT).cast("int").alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", "was", "is"))).alias("kids"))
        one = lambda x: F.sha2(F.to_json(F.transform("kids", lambda k: F.struct(k.node, k[x]))), 256)
        levels.insert(0, kids.select(F.col("up").alias("node"), one("was").alias("was"), one("is").alias("is")))
    return levels


def changed_leaves(levels: list[DataFrame]) -> DataFrame:
    """Leaves whose digests differ: from the root down, only children of differing nodes are compared."""
    differing: DataFrame | None = None
    for nodes in levels:
        if differing is not None:
            up = F.broadcast(differing.select(F.col("node").alias("up")))  # at most FANOUT ** level rows
            nodes = nodes.join(up, (F.col("node") / FANOUT).cast("int") == F.col("up"), "left_semi")
        differing = nodes.where(F.col("was") != F.col("is")).select("node")
    return differing.withColumnRenamed("node", "leaf")


def time_splits(claims: DataFrame, parts: int = TIME_PARTS) -> list[int]:
    """At most parts - 1 moments that cut the claims' time axis into parts of about equal size."""
    at = claims.agg(F.percentile_approx("t", [i / parts for i in range(1, parts)], 10_000)).first()[0]
    return sorted(set(at or []))


def _part(t: Column, splits: list[int], base: int = 0) -> Column:
    """Number of splits that are <= t, by halving, so it stays in generated code."""
    if not splits:
        return F.lit(base)
    mid = len(splits) // 2
    return F.when(t < splits[mid], _part(t, splits[:mid], base)).otherwise(_part(t, splits[mid + 1 :], base + mid + 1))


def versions(claims: DataFrame, splits: list[int], value: str = "value") -> DataFrame:
    """Longest runs of equal values in each slot's claims by t: (entity, property, value, valid_from_us, valid_to_us).

    valid_to_us is the start of the slot's next version, -1 for the last one. A slot that holds a third of all
    claims is cut by the time parts: runs are found within each part, and a second, small pass over one summary row
    per (slot, part) says whether a part's first run continues the one before and when the next run begins.
    """
    rows = claims.where(F.col(value).isNotNull()).select(*SLOT, "t", F.col(value).alias("value"), _part(F.col("t"), splits).alias("part"))
    within = Window.partitionBy(*SLOT, "part").orderBy("t")
    starts = rows.withColumn("before", F.lag("value").over(within)).where(F.col("before").isNull() | (F.col("before") != F.col("value")))
    runs = starts.withColumns({"next_t": F.lead("t").over(within), "opens": F.col("before").isNull()})
    parts = runs.groupBy(*SLOT, "part").agg(
        F.max(F.when(F.col("opens"), F.struct("value", "t", "next_t"))).alias("head"), F.max_by("value", "t").alias("tail")
    )
    across = Window.partitionBy(*SLOT).orderBy("part")
    joined = parts.withColumn("continues", F.coalesce(F.lag("tail").over(across) == F.col("head.value"), F.lit(False)))
    begin = F.when(F.col("continues"), F.col("head.next_t")).otherwise(F.col("head.t"))
    joined = joined.withColumn("later_t", F.first(begin, ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)))
    placed = runs.join(joined.select(*SLOT, "part", "continues", "later_t"), [*SLOT, "part"])
    return placed.where(~(F.col("opens") & F.col("continues"))).select(*SLOT, "value", F.col("t").alias("valid_from_us"), F.coalesce("next_t", "later_t", F.lit(-1)).alias("valid_to_us"))


def changed_slots(claims: DataFrame, leaves: DataFrame) -> DataFrame:
    """Slots in the given leaves with a claim that only one snapshot has or whose value differs."""
    return claims.join(F.broadcast(leaves), "leaf", "left_semi").where(~F.col("value").eqNullSafe(F.col("old_value"))).select(*SLOT).distinct()  # leaves: at most FANOUT ** LEVELS


def append_snapshot(log: DataFrame, claims: DataFrame, splits: list[int], snapshot: int) -> DataFrame:
    """What the newer snapshot appends to the log: versions that begin to hold (op 1) or are withdrawn (op -1).

    log: (entity, property, value, valid_from_us, valid_to_us, op, snapshot). Only slots in changed leaves are read.
    """
    leaves = changed_leaves(tree(materialize(leaf_digests(claims), "leaves")))
    slots = materialize(changed_slots(claims, leaves), "slots")
    fresh = versions(claims.join(slots, SLOT, "left_semi"), splits).withColumn("op", F.lit(1))
    held = current_versions(log).join(slots, SLOT, "left_semi").withColumn("op", F.lit(-1))
    diff = fresh.unionByName(held).groupBy(*VERSION).agg(F.sum("op").cast("int").alias("op")).where(F.col("op") != 0)
    return diff.withColumn("snapshot", F.lit(snapshot))


def current_versions(log: DataFrame) -> DataFrame:
    """The history as the log now has it: versions added and not withdrawn."""
    return log.groupBy(*VERSION).agg(F.sum("op").alias("held")).where(F.col("held") > 0).select(*VERSION)


def attribute_history(items: DataFrame, days_back: int = 30) -> DataFrame:
    """Full history of every slot of items: (entity, property, value, valid_from_us, valid_to_us).

    The log starts with the versions of the snapshot of days_back days before the newest update; the snapshot of now
    is compared with it and appended. Blank fields and null times make no claim, repeated rows count once, an empty
    table gives an empty history. Columns besides those named in claims_from are not read.
    """
    newest = items.agg(F.max("updated_at")).first()[0]
    as_of = F.lit(newest) - F.expr(f"INTERVAL {int(days_back)} DAYS") if newest is not None else None
    claims = materialize(claims_from(items, as_of), "claims")
    splits = time_splits(claims)
    log = materialize(versions(claims, splits, "old_value").withColumns({"op": F.lit(1), "snapshot": F.lit(0)}), "versions")
    grown = reduce(DataFrame.unionByName, [log, append_snapshot(log, claims, splits, 1)])
    return current_versions(grown)
