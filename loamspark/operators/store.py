"""Scans, filters and mutations of the claim store, as whole-table transformations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effective_ts(*cols: str) -> Column:
    """First non-null of the time columns: when a claim was last known to hold."""
    return F.coalesce(*[F.col(c) for c in cols or ("last_confirmed", "first_seen", "created_at")])


def metadata_filter(equal: dict | None = None, min_confidence: float | None = None, since: str | None = None, until: str | None = None, as_of: str | None = None) -> Column:
    """One conjunction of plain comparisons, so that the scan gets it. Undated rows pass the time bounds."""
    keep = F.lit(True)
    for k, v in (equal or {}).items():
        keep = keep & (F.coalesce(F.col(k), F.lit("")) == v)
    if min_confidence is not None:
        keep = keep & (F.coalesce(F.col("confidence"), F.lit(0.0)) >= min_confidence)
    at = F.coalesce("last_confirmed", "first_seen")
    if since is not None:
        keep = keep & (at.isNull() | (at >= F.lit(since).cast("timestamp")))
    upper = [F.lit(x).cast("timestamp") for x in (until, as_of) if x is not None]
    if upper:
        keep = keep & (at.isNull() | (at <= (F.least(*upper) if len(upper) > 1 else upper[0])))
    return keep


def substring_search(df: DataFrame, query: str, limit: int) -> DataFrame:
    """Rows whose text holds query in any case, best first: confidence, importance, recency, id."""
    hit = df.where(F.contains(F.lower("text"), F.lit(query.lower())))
    return hit.orderBy(F.desc_nulls_last("confidence"), F.desc_nulls_last("importance"), F.desc_nulls_last("last_confirmed"), "id").limit(limit)


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], keep_first: Sequence[str] = ()) -> DataFrame:
    """existing with incoming rows put in by key; of keep_first columns an existing non-null value stays.

    keys must be unique on either side. One full join, so both sides are shuffled once; no row is collected.
    """
    mine, other = existing.alias("old"), incoming.alias("new")
    on = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
    joined = mine.withColumn("_old", F.lit(True)).alias("old").join(other.withColumn("_new", F.lit(True)).alias("new"), on, "full")

    def pick(c: str) -> Column:
        if c in keep_first:
            return F.coalesce(f"old.{c}", f"new.{c}").alias(c)
        return F.when(F.col("new._new"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)

    return joined.select(*[pick(c) for c in existing.columns])


def sparse_update(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """existing with the non-null values of changes put over its own; other rows and columns stay."""
    cols = [c for c in changes.columns if c != key]
    joined = existing.join(changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols]), key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in existing.columns])


def reconfirm(existing: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Rows named in ids get last_confirmed = at and one more reinforcement."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    joined = existing.join(hit, "id", "left")
    return joined.withColumns({"last_confirmed": F.when(F.col("_hit"), at).otherwise(F.col("last_confirmed")), "reinforcement_count": F.coalesce("reinforcement_count", F.lit(0)) + F.when(F.col("_hit"), 1).otherwise(0)}).drop("_hit")


def append_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The rows of incoming whose key isn't there yet, one per key."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def union_first(parts: Sequence[DataFrame], key: Column, order: Column) -> DataFrame:
    """Union in which the first row of each key stays: by the parts' order, then by `order`."""
    tagged = [p.withColumn("_source", F.lit(i)) for i, p in enumerate(parts)]
    all_ = tagged[0]
    for p in tagged[1:]:
        all_ = all_.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_source", order)
    return all_.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def quarantine(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to write, rows to set aside): one bad row never stops the others. Null counts as bad."""
    ok = F.coalesce(good, F.lit(False))
    return df.where(ok), df.where(~ok)
