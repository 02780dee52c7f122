"""Registered queries of the general data problems, with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from loamspark.operators.copydiff import parity_issues
from loamspark.operators.history import attribute_history
from loamspark.session import table


def p2_found(spark, sf_dir):
    return attribute_history(table(spark, sf_dir, "memory_items"))


def p5_found(spark, sf_dir):
    return parity_issues(spark, sf_dir)


QUERIES = {"p2_found": p2_found, "p5_found": p5_found}

_FOLD = r"trim(regexp_replace({0}, '[ \t\r\n]+', ' ', 'g'))"


def _fold(c: str) -> str:
    return _FOLD.format(c)


SQL = {
    "p2_found": f"""
WITH cur AS (SELECT * FROM memory_items QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1),
c AS (SELECT id, lower({_fold('entity')}) AS entity, lower({_fold('property')}) AS property, {_fold('value')} AS value, epoch_us(first_seen) AS t
      FROM cur WHERE first_seen IS NOT NULL AND length({_fold('entity')}) > 0 AND length({_fold('property')}) > 0 AND length({_fold('value')}) > 0),
d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY entity, property, t ORDER BY id) = 1),
s AS (SELECT * FROM (SELECT *, lag(value) OVER (PARTITION BY entity, property ORDER BY t) AS before FROM d) WHERE before IS NULL OR before <> value)
SELECT entity, property, value, t AS valid_from_us, coalesce(lead(t) OVER (PARTITION BY entity, property ORDER BY t), -1) AS valid_to_us FROM s""",
    "p5_found": f"""
WITH rep AS (SELECT * FROM parity_report WHERE report_id = 'parity-0002'),
pg AS (SELECT DISTINCT id FROM (SELECT unnest(pg_ids) AS id FROM rep) WHERE id IS NOT NULL),
qd AS (SELECT DISTINCT id FROM (SELECT unnest(qdrant_ids) AS id FROM rep) WHERE id IS NOT NULL),
ne AS (SELECT DISTINCT id FROM (SELECT unnest(neo4j_ids) AS id FROM rep) WHERE id IS NOT NULL),
cur AS (SELECT * FROM memory_items QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1),
pt AS (SELECT coalesce(payload->>'$.id', payload->>'$.memory_id') AS id, updated_at, payload->>'$.text' AS text, payload->>'$.memory_type' AS memory_type, payload->>'$.scope' AS scope,
       payload->>'$.entity' AS entity, payload->>'$.property' AS property, payload->>'$.value' AS value, payload->>'$.status' AS status,
       CAST(payload->>'$.confidence' AS DOUBLE) AS confidence, CAST(payload->>'$.importance' AS DOUBLE) AS importance FROM qdrant_points),
p1 AS (SELECT * FROM pt QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1),
n1 AS (SELECT * FROM neo4j_nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY node_no DESC) = 1),
v AS (SELECT c.id, unnest([{', '.join(f"CASE WHEN c.{f} IS DISTINCT FROM p.{f} THEN '{f}' END" for f in ['text', 'memory_type', 'scope', 'entity', 'property', 'value', 'status', 'confidence', 'importance'])}]) AS field_name
      FROM cur c JOIN p1 p ON c.id = p.id WHERE c.id IN (SELECT id FROM pg) AND c.id IN (SELECT id FROM qd)),
g AS (SELECT c.id, unnest([{', '.join(f"CASE WHEN {e} IS DISTINCT FROM n.{f} THEN '{f}' END" for f, e in [('text', 'c.text'), ('memory_type', 'c.memory_type'), ('scope', "coalesce(c.scope, 'stable')"), ('entity', 'c.entity'), ('property', 'c.property'), ('value', 'c.value'), ('confidence', 'coalesce(c.confidence, 0)'), ('importance', 'coalesce(c.importance, 0)')])}]) AS field_name
      FROM cur c JOIN n1 n ON c.id = n.id WHERE c.id IN (SELECT id FROM pg) AND c.id IN (SELECT id FROM ne))
SELECT id AS item_id, 'missing_in_qdrant' AS issue_type, '' AS field_name FROM pg WHERE id NOT IN (SELECT id FROM qd)
UNION ALL SELECT id, 'missing_in_neo4j', '' FROM pg WHERE id NOT IN (SELECT id FROM ne) AND id IN (SELECT id FROM cur WHERE length({_fold('entity')}) > 0 AND length({_fold('property')}) > 0 AND length({_fold('value')}) > 0)
UNION ALL SELECT id, 'orphan_in_qdrant', '' FROM qd WHERE id NOT IN (SELECT id FROM pg)
UNION ALL SELECT id, 'orphan_in_neo4j', '' FROM ne WHERE id NOT IN (SELECT id FROM pg)
UNION ALL SELECT id, 'stale_vector', field_name FROM v WHERE field_name IS NOT NULL
UNION ALL SELECT id, 'stale_graph', field_name FROM g WHERE field_name IS NOT NULL""",
}
