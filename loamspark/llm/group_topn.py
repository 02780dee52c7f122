"""Top N rows of every group, pruned by partition lower bounds.

The N-th best score that a partition sees for a group is a lower bound for the group's N-th best: nothing below the
greatest of these bounds can be in the result. Each partition keeps its own N best per group, which gives the bounds;
their maximum per group is joined back, rows below it are dropped, and only the survivors are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamspark.functions.text import not_blank, slot_key
from loamspark.operators.rows import current_rows
from loamspark.session import materialize


def _local_best(keys: Sequence[str], n: int):
    """First n rows of each group in batches sorted by group and rank; `nth` marks a group's n-th."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None
        seen = 0
        for b in batches:
            rows = b.num_rows
            if not rows:
                continue
            new = np.zeros(rows, bool)
            for k in keys:
                c = b[k]
                same = pc.equal(c.slice(0, rows - 1), c.slice(1)).to_numpy(zero_copy_only=False)
                new[1:] |= ~same.astype(bool)
            first = [b[k][0].as_py() for k in keys]
            new[0] = first != last
            at = np.arange(rows)
            start = np.maximum.accumulate(np.where(new, at, -1))
            rank = np.where(start >= 0, at - start, at + seen)
            seen = int(rank[-1]) + 1
            last = [b[k][rows - 1].as_py() for k in keys]
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(rank == n - 1)], [*b.schema.names, "nth"])
            yield out.filter(pa.array(rank < n))

    return run


def top_n(df: DataFrame, keys: Sequence[str], score: str, tie: str, n: int) -> DataFrame:
    """(keys, pos, tie): the n rows of each group with the greatest score, equal scores by smaller tie.

    keys, score and tie must not be null and keys must be strings. Other columns are not read. Groups with fewer than
    n rows come out whole; repeated rows each count.
    """
    order = [F.col(score).desc(), F.col(tie)]
    local = df.select(*keys, score, tie).sortWithinPartitions(*keys, *order)
    schema = ", ".join(f"`{c}` {t}" for c, t in local.dtypes) + ", nth boolean"
    best = materialize(local.mapInArrow(_local_best(list(keys), n), schema), "partition-best")
    bounds = best.where("nth").groupBy(*keys).agg(F.max(score).alias("bound"))
    kept = best.join(bounds, list(keys), "left").where(F.col("bound").isNull() | (F.col(score) >= F.col("bound")))
    ranked = kept.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("pos") <= n).select(*keys, F.col("pos").cast("long").alias("pos"), tie)


def latest_claims(items: DataFrame, n: int = 3) -> DataFrame:
    """(entity, property, pos, id): the n claims of each slot with the latest last_confirmed, ties by smaller id.

    Uses the current row of each id whose entity and property are not blank and whose last_confirmed is not null;
    slots are named folded and in lower case. An empty table gives no rows.
    """
    rows = current_rows(items, "id", "updated_at", ["entity", "property", "last_confirmed"])
    rows = rows.where(not_blank(F.col("entity")) & not_blank(F.col("property")) & F.col("last_confirmed").isNotNull())
    slots = rows.select(slot_key(F.col("entity")).alias("entity"), slot_key(F.col("property")).alias("property"), F.unix_micros(F.col("last_confirmed").cast("timestamp")).alias("score"), "id")
    return top_n(slots, ["entity", "property"], "score", "id", n)
