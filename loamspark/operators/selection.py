"""Choices that depend on what was chosen before: budgets and near-duplicates over a bounded head of ranked rows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_budget(df: DataFrame, group: str, order: list[Column], cost: Column, budget: float) -> DataFrame:
    """Rows of each group, in order, while their running cost stays within the budget."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def greedy_packet(df: DataFrame, group: str, key: str, text: str, score: str, head: int, items: int, tokens: int) -> DataFrame:
    """(group, key, place): best rows of each group that fit the item and token budgets, near-duplicates skipped.

    A row that doesn't fit is skipped, smaller ones after it may fit. Only the first `head` rows of a group are looked
    at, so a group's share in one task is bounded however large the group is. Null texts count as empty.
    """
    w = Window.partitionBy(group).orderBy(F.desc(score), key)
    top = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= head).select(group, key, F.coalesce(text, F.lit("")).alias("text"), "_r")
    kind = dict(df.dtypes)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, seen, left = [], [], tokens
        for row in pdf.sort_values("_r").itertuples(index=False):
            g, k, t, _ = row
            form = re.sub("[^a-z0-9]", "", t.lower())
            cost = max(1, len(t) // 4)
            near = any(form == s or (min(len(form), len(s)) >= 24 and (form in s or s in form)) for s in seen)
            if near or cost > left or len(taken) >= items:
                continue
            left -= cost
            seen.append(form)
            taken.append((g, k, len(taken) + 1))
        return pd.DataFrame(taken, columns=[group, key, "place"])

    return top.groupBy(group).applyInPandas(choose, f"`{group}` {kind[group]}, `{key}` {kind[key]}, place long")


def file_change(old_inode: Column, old_size: Column, new_inode: Column, new_size: Column, same_head: Column) -> Column:
    """How a followed file changed since its cursor: fresh, unchanged, append, truncated, rotated or unknown."""
    return (
        F.when(new_inode.isNull(), "unknown").when(old_inode.isNull(), "fresh").when(old_inode != new_inode, "rotated").when(new_size < old_size, "truncated")
        .when(~F.coalesce(same_head, F.lit(True)), "rotated").when(new_size == old_size, "unchanged").otherwise("append")
    )
