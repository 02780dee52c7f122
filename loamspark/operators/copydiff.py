"""Differences between two copies of a dataset.

Both copies go into one stream of (key, side, fields), range-partitioned by key, so that they share their split
points; partitions are sorted by key and side, and a two-pointer pass over each emits what differs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamspark.functions.text import not_blank
from loamspark.operators.rows import current_rows
from loamspark.session import materialize, table

#: Longer strings travel as their SHA-256: equality is all that is asked of them.
DIGEST_FROM = 64
MISSING_LEFT, MISSING_RIGHT, DIFFERS = "missing_left", "missing_right", "differs"


def _same_or_digest(c: Column) -> Column:
    return F.when(F.length(c) > DIGEST_FROM, F.concat(F.lit("sha256:"), F.sha2(c, 256))).otherwise(F.concat(F.lit("="), c))


def _merge(fields: Sequence[str]):
    """Two-pointer merge over batches sorted by (key, side): side 0 left, 1 right, keys unique within a side."""

    def emit(t: pa.Table) -> pa.RecordBatch:
        n = t.num_rows
        key, side = t["key"].combine_chunks(), t["side"].combine_chunks()
        one = pa.array([False])
        pair = pa.concat_arrays([pc.equal(key.slice(0, n - 1), key.slice(1)), one]) if n > 1 else pa.array([False] * n)
        second = pa.concat_arrays([one, pair.slice(0, n - 1)]) if n else pair
        alone = pc.invert(pc.or_(pair, second))
        keys, kinds, names = [], [], []
        for at, kind in ((0, MISSING_RIGHT), (1, MISSING_LEFT)):
            found = key.filter(pc.and_(alone, pc.equal(side, at)))
            keys.append(found)
            kinds.append(pa.array([kind] * len(found), pa.string()))
            names.append(pa.array([""] * len(found), pa.string()))
        left = pc.indices_nonzero(pair)
        right = pc.add(left, 1)
        both = pc.and_(pc.take(t["listed"].combine_chunks(), left), pc.take(t["listed"].combine_chunks(), right))
        for f in fields:
            a, b = (pc.take(t[f].combine_chunks(), x) for x in (left, right))
            same = pc.if_else(pc.is_null(pc.equal(a, b)), pc.and_(pc.is_null(a), pc.is_null(b)), pc.equal(a, b))
            found = pc.take(key, left).filter(pc.and_(pc.invert(same), both))
            keys.append(found)
            kinds.append(pa.array([DIFFERS] * len(found), pa.string()))
            names.append(pa.array([f] * len(found), pa.string()))
        cast = lambda xs: pa.concat_arrays([x.cast(pa.string()) for x in xs])
        return pa.record_batch([cast(keys), cast(kinds), cast(names)], ["key", "kind", "field_name"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            if t.num_rows < 2:
                held = t
                continue
            # the last row's partner may be in the next batch
            held, t = t.slice(t.num_rows - 1), t.slice(0, t.num_rows - 1)
            if t["key"][t.num_rows - 1].as_py() == held["key"][0].as_py():
                held, t = pa.concat_tables([t.slice(t.num_rows - 1), held]), t.slice(0, t.num_rows - 1)
            if t.num_rows:
                yield emit(t)
        if held is not None:
            yield emit(held)

    return run


def diff_copies(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, kind, field_name): keys missing on either side, and one row for each field whose values differ.

    key must be unique in each copy and not null (rows with a null key are left out). Fields are compared as strings
    or numbers of the same type on both sides; null equals null and differs from any value. field_name is '' for
    missing keys. If both copies have a boolean column `listed`, fields are compared only where it is true in both.
    Other columns are not read. Two empty copies have no differences.
    """
    listed = "listed" in left.columns and "listed" in right.columns and "listed" not in fields

    def side(df: DataFrame, n: int) -> DataFrame:
        kinds = dict(df.dtypes)
        cols = [(_same_or_digest(F.col(f)) if kinds[f] == "string" else F.col(f)).alias(f) for f in fields]
        return df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.lit(n).alias("side"), (F.col("listed") if listed else F.lit(True)).alias("listed"), *cols)

    stream = side(left, 0).unionByName(side(right, 1))
    merged = stream.repartitionByRange("key").sortWithinPartitions("key", "side")
    return merged.mapInArrow(_merge(list(fields)), "key string, kind string, field_name string")


TEXT_FIELDS = ["text", "memory_type", "scope", "entity", "property", "value", "status"]
NUMBER_FIELDS = ["confidence", "importance"]
PAYLOAD_FIELDS = [*TEXT_FIELDS, *NUMBER_FIELDS]
GRAPH_FIELDS = [f for f in PAYLOAD_FIELDS if f != "status"]
#: What the graph's writer stores for a null.
GRAPH_DEFAULTS = {"scope": "stable", "confidence": 0.0, "importance": 0.0}


def listed_ids(report: DataFrame, column: str) -> DataFrame:
    """Distinct ids of one store's list over all pages, without nulls."""
    return report.select(F.explode(column).alias("id")).where(F.col("id").isNotNull()).distinct()


def parse_points(points: DataFrame) -> DataFrame:
    """(id, updated_at, fields) of stored payloads; numbers may be written as text, the id under either name."""
    schema = "id string, memory_id string, " + ", ".join(f"{f} string" for f in PAYLOAD_FIELDS)
    p = points.select(F.from_json("payload", schema).alias("p"), "updated_at")
    return p.select(F.coalesce("p.id", "p.memory_id").alias("id"), "updated_at", *[F.col(f"p.{f}") for f in TEXT_FIELDS], *[F.col(f"p.{f}").try_cast("double").alias(f) for f in NUMBER_FIELDS])


def store_parity(items: DataFrame, points: DataFrame, nodes: DataFrame, report: DataFrame, report_id: str) -> DataFrame:
    """(item_id, issue_type, field_name) of one parity report against the rows of the three stores.

    Ids come from the report's lists; an id is compared field by field if both lists and both stores have it. Points
    stored twice count by the newest updated_at, nodes by the greatest node_no. Null lists, null ids and empty tables
    give no issue of their own.
    """
    pages = report.where(F.col("report_id") == report_id)
    ids = {c: listed_ids(pages, c).withColumn("on", F.lit(True)) for c in ("pg_ids", "qdrant_ids", "neo4j_ids")}
    rows = current_rows(items, "id", "updated_at", PAYLOAD_FIELDS)
    full = not_blank(F.col("entity")) & not_blank(F.col("property")) & not_blank(F.col("value"))

    def with_rows(listing: DataFrame, store: DataFrame) -> DataFrame:
        return listing.join(store.withColumn("listed", F.lit(True)), "id", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))

    left = materialize(with_rows(ids["pg_ids"], rows).withColumn("full", full), "parity-left")
    vector = with_rows(ids["qdrant_ids"], current_rows(parse_points(points), "id", "updated_at", PAYLOAD_FIELDS))
    graph = with_rows(ids["neo4j_ids"], current_rows(nodes, "id", "node_no", GRAPH_FIELDS))
    as_graph = left.withColumns({f: F.coalesce(f, F.lit(v)) for f, v in GRAPH_DEFAULTS.items()})

    out = []
    for store, base, copy, fields, stale in (("qdrant", left, vector, PAYLOAD_FIELDS, "stale_vector"), ("neo4j", as_graph, graph, GRAPH_FIELDS, "stale_graph")):
        d = diff_copies(base, copy, "id", fields)
        if store == "neo4j":
            # the graph holds complete claims only, so an incomplete one isn't missing there
            partial = left.where(~F.col("full")).select(F.col("id").alias("key"), F.lit(MISSING_RIGHT).alias("kind"))
            d = d.join(partial, ["key", "kind"], "left_anti")
        kind = F.when(F.col("kind") == MISSING_RIGHT, f"missing_in_{store}").when(F.col("kind") == MISSING_LEFT, f"orphan_in_{store}").otherwise(stale)
        out.append(d.select(F.col("key").alias("item_id"), kind.alias("issue_type"), "field_name"))
    return out[0].unionByName(out[1])


def parity_issues(spark, sf_dir: str, report_id: str = "parity-0002") -> DataFrame:
    """store_parity over the tables of sf_dir."""
    return store_parity(*[table(spark, sf_dir, t) for t in ("memory_items", "qdrant_points", "neo4j_nodes", "parity_report")], report_id)
