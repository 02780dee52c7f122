"""Queries on scans, filters, mutations and set operations (SRC, SNK, FLT, SET)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamspark.operators import store
from loamspark.plans.common import as_of, Registry, claims, feedback
from loamspark.session import table

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL


@R("SRC03_scan_by_statuses", "SELECT id, status, lifecycle_state FROM {CUR} WHERE status IN ('active', 'superseded')")
def _(s, d):
    return claims(s, d, "status", "lifecycle_state").where(F.col("status").isin("active", "superseded"))


@R("SRC04_queue_payloads", "SELECT id, payload->>'$.memory_type' AS memory_type, payload->>'$.scope' AS scope FROM memory_discarded WHERE json_valid(payload)")
def _(s, d):
    p = F.try_parse_json("payload")
    return table(s, d, "memory_discarded").select("id", p.alias("p")).where("p IS NOT NULL").select("id", F.try_variant_get("p", "$.memory_type", "string").alias("memory_type"), F.try_variant_get("p", "$.scope", "string").alias("scope"))


@R("SRC05_recent_discards", "SELECT DISTINCT id, discarded_at FROM memory_discarded WHERE discarded_at IS NULL OR discarded_at > {AS_OF} - INTERVAL 180 DAY")
def _(s, d):
    at = F.col("discarded_at")
    return table(s, d, "memory_discarded").where(at.isNull() | (at > as_of() - F.expr("INTERVAL 180 DAYS"))).select("id", "discarded_at").distinct()


@R("SRC06_page_by_id", "SELECT id, entity FROM {CUR} ORDER BY id LIMIT 50 OFFSET 100")
def _(s, d):
    return claims(s, d, "entity").orderBy("id").offset(100).limit(50)


@R("SRC14_parameterised_sql", "SELECT memory_type, count(*) AS n FROM memory_items WHERE confidence >= 0.5 GROUP BY memory_type")
def _(s, d):
    return s.sql("SELECT memory_type, count(*) AS n FROM {items} WHERE confidence >= :least GROUP BY memory_type", args={"least": 0.5}, items=table(s, d, "memory_items"))


@R("SRC16_generated_needles", "SELECT range AS n, 'needle-' || CAST(range % 40 AS VARCHAR) AS needle, range * 37 % 1000 AS place FROM range(5000)")
def _(s, d):
    n = F.col("id")
    return s.range(5000).select(n.alias("n"), F.concat(F.lit("needle-"), (n % 40).cast("string")).alias("needle"), (n * 37 % 1000).alias("place"))


@R("SRC17_point_lookup", "SELECT id, text FROM {CUR} WHERE id = (SELECT min(id) FROM memory_items)")
def _(s, d):
    first = table(s, d, "memory_items").agg(F.min("id").alias("id"))
    return claims(s, d, "text").join(F.broadcast(first), "id", "left_semi")  # one row


@R("SNK01_upsert_items", """
WITH old AS (SELECT id, value, first_seen, status FROM {CUR} WHERE memory_type <> 'fact'),
new AS (SELECT id, upper(value) AS value, created_at AS first_seen, 'active' AS status FROM {CUR} WHERE memory_type IN ('fact', 'decision'))
SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.value ELSE o.value END AS value, coalesce(o.first_seen, n.first_seen) AS first_seen,
 CASE WHEN n.id IS NOT NULL THEN n.status ELSE o.status END AS status FROM old o FULL JOIN new n ON o.id = n.id""")
def _(s, d):
    c = claims(s, d, "value", "first_seen", "status", "created_at", "memory_type")
    old = c.where("memory_type <> 'fact'").select("id", "value", "first_seen", "status")
    new = c.where("memory_type IN ('fact', 'decision')").select("id", F.upper("value").alias("value"), F.col("created_at").alias("first_seen"), F.lit("active").alias("status"))
    return store.upsert(old, new, ["id"], keep_first=["first_seen"])


@R("SNK02_upsert_queue", """
WITH old AS (SELECT DISTINCT id, payload, discarded_at FROM memory_discarded), new AS (SELECT DISTINCT id, lower(payload) AS payload, TIMESTAMPTZ '2026-09-01 00:00:00+00' AS discarded_at FROM memory_discarded WHERE id < 'dc_8')
SELECT coalesce(o.id, n.id) AS id, coalesce(n.payload, o.payload) AS payload, coalesce(o.discarded_at, n.discarded_at) AS discarded_at FROM old o FULL JOIN new n ON o.id = n.id""")
def _(s, d):
    old = table(s, d, "memory_discarded").select("id", "payload", "discarded_at").distinct()
    new = old.where("id < 'dc_8'").select("id", F.lower("payload").alias("payload"), as_of().alias("discarded_at"))
    return store.upsert(old, new, ["id"], keep_first=["discarded_at"])


@R("SNK07_sparse_update", """
SELECT o.id, coalesce(n.importance, o.importance) AS importance, coalesce(n.confidence, o.confidence) AS confidence FROM {CUR} o
LEFT JOIN (SELECT id, CASE WHEN memory_type = 'fact' THEN 0.9 END AS importance, CASE WHEN memory_type = 'decision' THEN 0.7 END AS confidence FROM {CUR}) n ON o.id = n.id""")
def _(s, d):
    c = claims(s, d, "importance", "confidence", "memory_type")
    new = c.select("id", F.when(F.col("memory_type") == "fact", 0.9).alias("importance"), F.when(F.col("memory_type") == "decision", 0.7).alias("confidence"))
    return store.sparse_update(c.drop("memory_type"), new, "id")


@R("SNK08_reconfirm", """
WITH hit AS (SELECT DISTINCT id FROM {CUR} WHERE memory_type = 'fact')
SELECT c.id, CASE WHEN h.id IS NOT NULL THEN {AS_OF} ELSE c.last_confirmed END AS last_confirmed, coalesce(c.reinforcement_count, 0) + CASE WHEN h.id IS NOT NULL THEN 1 ELSE 0 END AS reinforcement_count FROM {CUR} c LEFT JOIN hit h ON c.id = h.id""")
def _(s, d):
    c = claims(s, d, "last_confirmed", "reinforcement_count", "memory_type")
    return store.reconfirm(c.drop("memory_type"), c.where("memory_type = 'fact'"), as_of())


@R("SNK09_archive_ids", "SELECT id, CASE WHEN status = 'active' AND memory_type = 'observation' THEN 'consolidated' ELSE status END AS status FROM {CUR}")
def _(s, d):
    c = claims(s, d, "status", "memory_type")
    hit = c.where("memory_type = 'observation'").select("id", F.lit(True).alias("hit"))
    return c.select("id", "status").join(hit, "id", "left").select("id", F.when(F.col("hit") & (F.col("status") == "active"), "consolidated").otherwise(F.col("status")).alias("status"))


@R("SNK14_quarantine", "SELECT CASE WHEN json_valid(payload) THEN 'written' ELSE 'set aside' END AS side, count(*) AS n FROM memory_discarded GROUP BY ALL")
def _(s, d):
    good, bad = store.quarantine(table(s, d, "memory_discarded"), F.try_parse_json("payload").isNotNull())
    return good.agg(F.lit("written").alias("side"), F.count(F.lit(1)).alias("n")).unionByName(bad.agg(F.lit("set aside").alias("side"), F.count(F.lit(1)).alias("n"))).where("n > 0")


@R("SNK16_append_new_events", "SELECT event_id, event_type FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view')")
def _(s, d):
    e = table(s, d, "events").select("event_id", "event_type")
    return store.append_new(e.where("event_type = 'view'"), e, "event_id")


_BOUNDS = {"equal": {"status": "active"}, "min_confidence": 0.3, "since": "2025-06-01 00:00:00", "until": "2026-07-01 00:00:00", "as_of": "2026-05-01 00:00:00"}


@R("FLT01_metadata_filter", """
SELECT id, status, confidence FROM {CUR} WHERE coalesce(status, '') = 'active' AND coalesce(confidence, 0) >= 0.3
AND (coalesce(last_confirmed, first_seen) IS NULL OR (coalesce(last_confirmed, first_seen) >= TIMESTAMPTZ '2025-06-01 00:00:00+00' AND coalesce(last_confirmed, first_seen) <= TIMESTAMPTZ '2026-05-01 00:00:00+00'))""")
def _(s, d):
    return claims(s, d, "status", "confidence", "last_confirmed", "first_seen").where(store.metadata_filter(**_BOUNDS)).select("id", "status", "confidence")


@R("FLT04_range_or_undated", "SELECT id FROM {CUR} WHERE last_confirmed IS NULL OR last_confirmed BETWEEN TIMESTAMPTZ '2025-06-01 00:00:00+00' AND TIMESTAMPTZ '2025-12-01 00:00:00+00'")
def _(s, d):
    at = F.col("last_confirmed")
    return claims(s, d, "last_confirmed").where(at.isNull() | at.between(F.lit("2025-06-01").cast("timestamp"), F.lit("2025-12-01").cast("timestamp"))).select("id")


@R("FLT05_substring_search", """
SELECT id, confidence, importance FROM {CUR} WHERE contains(lower(text), 'compiler') ORDER BY confidence DESC NULLS LAST, importance DESC NULLS LAST, last_confirmed DESC NULLS LAST, id LIMIT 25""")
def _(s, d):
    return store.substring_search(claims(s, d, "text", "confidence", "importance", "last_confirmed"), "Compiler", 25).select("id", "confidence", "importance")


@R("FLT08_agent_prefix", "SELECT id, source_agent FROM {CUR} WHERE source_agent LIKE 'co%'")
def _(s, d):
    return claims(s, d, "source_agent").where(F.col("source_agent").startswith("co"))


@R("FLT09_half_open_window", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def _(s, d):
    return table(s, d, "events").where("ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-12 00:00:00'").select("event_id")


@R("FLT10_episode_search", """
SELECT id, created_at FROM {CUR} WHERE created_at >= TIMESTAMPTZ '2025-03-01 00:00:00+00' AND source_agent = 'main'
AND list_contains(string_split(lower(text), ' '), 'the') AND list_contains(string_split(lower(text), ' '), 'once') ORDER BY created_at DESC, id LIMIT 40""")
def _(s, d):
    terms = F.split(F.lower("text"), " ")
    c = claims(s, d, "text", "source_agent", "created_at").where((F.col("created_at") >= F.lit("2025-03-01").cast("timestamp")) & (F.col("source_agent") == "main"))
    return c.where(F.array_contains(terms, "the") & F.array_contains(terms, "once")).orderBy(F.desc("created_at"), "id").limit(40).select("id", "created_at")


@R("FLT15_status_recheck", """
SELECT p.point_id FROM (SELECT point_id, coalesce(payload->>'$.id', payload->>'$.memory_id') AS id FROM qdrant_points) p LEFT JOIN {CUR} c ON p.id = c.id WHERE coalesce(c.status, 'active') = 'active'""")
def _(s, d):
    p = table(s, d, "qdrant_points").select("point_id", F.coalesce(F.get_json_object("payload", "$.id"), F.get_json_object("payload", "$.memory_id")).alias("id"))
    return p.join(claims(s, d, "status"), "id", "left").where(F.coalesce("status", F.lit("active")) == "active").select("point_id")


@R("FLT16_ignored_paths", "SELECT DISTINCT file_path FROM code_chunks WHERE NOT list_has_any(string_split(file_path, '/'), ['tools', 'bench']) AND NOT file_path LIKE '%.md'")
def _(s, d):
    p = F.split("file_path", "/")
    return table(s, d, "code_chunks").where(~F.arrays_overlap(p, F.array(F.lit("tools"), F.lit("bench"))) & ~F.col("file_path").endswith(".md")).select("file_path").distinct()


@R("FLT17_json_projection", """
SELECT point_id, (payload->'$.confidence') IS NOT NULL AND json_type(payload, '$.confidence') IS NOT NULL AS has_confidence, TRY_CAST(payload->>'$.confidence' AS DOUBLE) AS confidence FROM qdrant_points""")
def _(s, d):
    v = F.parse_json("payload")
    return table(s, d, "qdrant_points").select("point_id", v.alias("v")).select("point_id", F.array_contains(F.expr("json_object_keys(to_json(v))"), "confidence").alias("has_confidence"), F.try_variant_get("v", "$.confidence", "string").try_cast("double").alias("confidence"))


@R("FLT18_like_any", "SELECT DISTINCT file_path FROM code_chunks WHERE file_path LIKE '%.py' OR file_path LIKE '%.cpp'")
def _(s, d):
    return table(s, d, "code_chunks").where("file_path LIKE ANY ('%.py', '%.cpp')").select("file_path").distinct()


@R("FLT19_domain_tags", "SELECT DISTINCT tag FROM (SELECT unnest(tags) AS tag, project_id FROM {CUR}) WHERE project_id = 'atlas' AND contains(tag, '.')")
def _(s, d):
    return claims(s, d, "tags", "project_id").where("project_id = 'atlas'").select(F.explode("tags").alias("tag")).where(F.contains("tag", F.lit("."))).distinct()


@R("SET01_union_ids", "SELECT id, count(*) AS n FROM (SELECT id FROM memory_items UNION ALL SELECT id FROM memory_discarded UNION ALL SELECT id FROM neo4j_nodes) GROUP BY id")
def _(s, d):
    a, b, c = (table(s, d, t).select("id") for t in ("memory_items", "memory_discarded", "neo4j_nodes"))
    return a.unionByName(b).unionByName(c).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@R("SET03_first_wins_merge", """
WITH u AS (SELECT 0 AS source, id, text FROM {CUR} WHERE text IS NOT NULL UNION ALL SELECT 1, id, text FROM neo4j_nodes WHERE text IS NOT NULL)
SELECT id, text, source FROM u QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY source, id) = 1""")
def _(s, d):
    a = claims(s, d, "text").where("text IS NOT NULL")
    b = table(s, d, "neo4j_nodes").select("id", "text").where("text IS NOT NULL")
    return store.union_first([a, b], F.md5("text"), F.col("id")).select("id", "text", F.col("_source").alias("source"))


@R("SET05_difference", "SELECT id, 'store only' AS side FROM (SELECT id FROM memory_items EXCEPT SELECT id FROM neo4j_nodes) UNION ALL SELECT id, 'graph only' FROM (SELECT id FROM neo4j_nodes EXCEPT SELECT id FROM memory_items)")
def _(s, d):
    a, b = (table(s, d, t).select("id") for t in ("memory_items", "neo4j_nodes"))
    return a.subtract(b).withColumn("side", F.lit("store only")).unionByName(b.subtract(a).withColumn("side", F.lit("graph only")))


@R("SET06_intersection", "SELECT id FROM memory_items INTERSECT SELECT id FROM neo4j_nodes")
def _(s, d):
    return table(s, d, "memory_items").select("id").intersect(table(s, d, "neo4j_nodes").select("id"))


@R("SET07_ordered_dedupe", "SELECT id, memory_type, scope, text FROM {CUR} WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY memory_type, scope, text ORDER BY id) = 1")
def _(s, d):
    w = Window.partitionBy("memory_type", "scope", "text").orderBy("id")
    return claims(s, d, "memory_type", "scope", "text").where("text IS NOT NULL").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


@R("SET08_unordered_pairs", """
WITH e AS (SELECT report_id || item_id AS a, issue_type AS b, 0 AS m FROM parity_issue UNION ALL SELECT issue_type, report_id || item_id, 1 FROM parity_issue)
SELECT least(a, b) AS a, greatest(a, b) AS b, min(m) AS method FROM e GROUP BY ALL""")
def _(s, d):
    i = table(s, d, "parity_issue").select(F.concat("report_id", "item_id").alias("a"), F.col("issue_type").alias("b"))
    e = i.withColumn("m", F.lit(0)).unionByName(i.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1).alias("m")))
    return e.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("m").alias("method"))
