"""Queries on the property graphs of claims and code (GRA, SNK15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamspark.operators import graph
from loamspark.plans.common import Registry, claims
from loamspark.session import table

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL


def _edges(s, d):
    return graph.claim_edges(claims(s, d, "scope", "entity", "property", "value"))


_N = "CASE WHEN trim(coalesce({1}, ''), ' ') <> '' THEN '{0}:' || {1} END"
_E, _P, _V = (_N.format(k, k) for k in ("entity", "property", "value"))
_S = "'scope:' || coalesce(scope, 'stable')"
_EDGES = f"""(SELECT DISTINCT * FROM (SELECT 'item:' || id AS src, {_S} AS dst, 'ASSERTED_IN' AS type FROM {{CUR}} UNION ALL SELECT {_S}, 'item:' || id, 'CONTAINS' FROM {{CUR}}
UNION ALL SELECT 'item:' || id, {_E}, 'ABOUT_ENTITY' FROM {{CUR}} UNION ALL SELECT {_E}, {_P}, 'HAS_PROPERTY' FROM {{CUR}} UNION ALL SELECT {_P}, {_V}, 'HAS_VALUE' FROM {{CUR}}) WHERE src IS NOT NULL AND dst IS NOT NULL)"""


@R("SNK15_claim_graph", f"SELECT src, dst, type FROM {_EDGES}")
def _(s, d):
    return _edges(s, d)


@R("GRA02_text_contains", "SELECT node_no, id FROM neo4j_nodes WHERE contains(lower(text), 'snapshot') AND scope = 'stable' ORDER BY confidence DESC NULLS LAST, importance DESC NULLS LAST, id, node_no LIMIT 20")
def _(s, d):
    n = table(s, d, "neo4j_nodes").where(F.contains(F.lower("text"), F.lit("snapshot")) & (F.col("scope") == "stable"))
    return n.orderBy(F.desc_nulls_last("confidence"), F.desc_nulls_last("importance"), "id", "node_no").limit(20).select("node_no", "id")


@R("GRA03_k_hops", f"""
WITH e AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM {_EDGES} WHERE type IN ('HAS_PROPERTY', 'HAS_VALUE') UNION ALL SELECT dst, src FROM {_EDGES} WHERE type IN ('HAS_PROPERTY', 'HAS_VALUE'))),
s AS (SELECT min(src) AS id FROM {_EDGES} WHERE type = 'HAS_PROPERTY'), h1 AS (SELECT DISTINCT dst AS node FROM e, s WHERE e.src = s.id), h2 AS (SELECT DISTINCT e.dst AS node FROM h1 JOIN e ON h1.node = e.src)
SELECT s.id AS start, node, min(hops) AS hops FROM (SELECT node, 1 AS hops FROM h1 UNION ALL SELECT node, 2 FROM h2), s WHERE node <> s.id GROUP BY ALL""")
def _(s, d):
    e = _edges(s, d)
    start = e.where("type = 'HAS_PROPERTY'").agg(F.min("src").alias("id"))
    return graph.k_hops(e, start, 2, ["HAS_PROPERTY", "HAS_VALUE"])


@R("AGG20_node_counts", "SELECT coalesce(memory_type, 'none') AS label, count(*) AS n FROM neo4j_nodes GROUP BY coalesce(memory_type, 'none')")
def _(s, d):
    return table(s, d, "neo4j_nodes").groupBy(F.coalesce("memory_type", F.lit("none")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
