"""Which of several rows of a key is its current one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current_struct(order: str, fields: Sequence[str]) -> Column:
    """Struct whose maximum belongs to the current row: greatest order, then content, null orders last."""
    return F.struct(F.col(order).isNotNull().alias("_has"), F.col(order).alias("_order"), *[F.col(x) for x in fields if x != order])


def current_rows(df: DataFrame, key: str, order: str, fields: Sequence[str]) -> DataFrame:
    """(key, fields) with one row per key: that with the greatest order (ties by content, so a rerun gives the same).

    Rows with a null key are left out. The maximum is combined map-side, so a key with a third of all rows
    costs one row per map task in the shuffle.
    """
    best = F.max(current_struct(order, fields)).alias("_best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"_best.{'_order' if x == order else x}").alias(x) for x in fields])


#: Parts that a group is numbered in.
NUMBERED_PARTS = 64


def numbered(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """df with the place (1 ..) of each row in its group by a numeric, unique order column.

    Rows are cut at quantiles of `order`; each part of a group is numbered on its own and moved on by the rows of the
    parts before, so a group with a third of all rows is spread over NUMBERED_PARTS windows. Null groups form one group;
    null orders come first.
    """
    at = F.col(order).cast("double")
    cuts = sorted(set(df.select(at.alias("_o")).where("_o IS NOT NULL").approxQuantile("_o", [i / NUMBERED_PARTS for i in range(1, NUMBERED_PARTS)], 0.005)))
    part = F.coalesce(F.aggregate(F.array(*[F.lit(float(c)) for c in cuts]), F.lit(0), lambda n, c: n + F.when(at > c, 1).otherwise(0)), F.lit(0)) if cuts else F.lit(0)
    parted = df.withColumn("_part", part)
    counts = parted.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), (F.sum("_n").over(Window.partitionBy(group).orderBy("_part")) - F.col("_n")).alias("_before"))
    within = parted.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_part").orderBy(order)))
    joined = within.join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.select(*df.columns, (F.col("_r") + F.col("_before")).cast("int").alias(name))
