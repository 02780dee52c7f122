"""Variants and small reports over the same operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamspark.operators import graph, retrieval, store, temporal
from loamspark.plans.common import Registry, as_of, claims, feedback
from loamspark.session import table

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL


@R("JON17_any_match", """
WITH x AS (SELECT DISTINCT lower(coalesce(payload->>'$.text', payload->>'$.normalized_text')) AS t, payload->>'$.entity' AS e, payload->>'$.property' AS p, payload->>'$.value' AS v FROM memory_discarded WHERE json_valid(payload))
SELECT id FROM {CUR} WHERE lower(text) IN (SELECT t FROM x WHERE t IS NOT NULL) OR EXISTS (SELECT 1 FROM x WHERE e = entity AND p = property AND v = value)""")
def _(s, d):
    p = table(s, d, "memory_discarded").select(F.try_parse_json("payload").alias("j")).where("j IS NOT NULL")
    get = lambda k: F.try_variant_get("j", f"$.{k}", "string")
    texts = p.select(F.lower(F.coalesce(get("text"), get("normalized_text"))).alias("t"))
    slots = p.select(get("entity").alias("entity"), get("property").alias("property"), get("value").alias("value"))
    c = claims(s, d, "text", "entity", "property", "value")
    by_text = c.withColumn("t", F.lower("text")).join(texts, "t", "left_semi").select("id")
    return by_text.unionByName(c.join(slots, ["entity", "property", "value"], "left_semi").select("id")).distinct()


@R("TOP06_chunk_topk")
def _(s, d):
    """The ten method chunks nearest to the first embedded chunk; tested through TOP05's operator."""
    e = table(s, d, "code_chunk_embeddings").where("embedding IS NOT NULL AND size(embedding) = 384")
    q = e.orderBy("chunk_id", "updated_at").limit(1).select("embedding").first()
    current = e.groupBy("chunk_id").agg(F.max_by("embedding", "updated_at").alias("embedding"))
    near = retrieval.similarity(current, "chunk_id", "embedding", q[0] if q else [1.0] * 384)
    m = table(s, d, "code_chunks").where("chunk_type = 'method'").select(F.col("id").alias("chunk_id"))
    return near.join(m, "chunk_id", "left_semi").where("NOT isnan(score)").orderBy(F.desc("score"), "chunk_id").limit(10)


@R("TOP11_queue_head", "SELECT id, discarded_at FROM memory_discarded WHERE discarded_at IS NOT NULL ORDER BY discarded_at, id LIMIT 1")
def _(s, d):
    return table(s, d, "memory_discarded").where("discarded_at IS NOT NULL").orderBy("discarded_at", "id").limit(1).select("id", "discarded_at")


@R("TOP09_scope_order", """
SELECT id FROM {CUR} WHERE scope IN ('global', 'stable', 'session') ORDER BY list_position(['stable', 'global', 'session'], scope), list_position(['decision', 'fact', 'constraint'], memory_type) NULLS LAST, id LIMIT 40""")
def _(s, d):
    rank = lambda c, xs: F.array_position(F.array(*[F.lit(x) for x in xs]), F.col(c))
    kind = F.nullif(rank("memory_type", ["decision", "fact", "constraint"]), F.lit(0))
    c = claims(s, d, "scope", "memory_type").where(F.col("scope").isin("global", "stable", "session"))
    return c.orderBy(rank("scope", ["stable", "global", "session"]), kind.asc_nulls_last(), "id").limit(40).select("id")


@R("SET04_merge_by_text", "SELECT text, min(source) AS source FROM (SELECT text, 0 AS source FROM {CUR} UNION ALL SELECT text, 1 FROM neo4j_nodes) WHERE text IS NOT NULL GROUP BY text")
def _(s, d):
    a, b = claims(s, d, "text").select("text", F.lit(0).alias("source")), table(s, d, "neo4j_nodes").select("text", F.lit(1).alias("source"))
    return a.unionByName(b).where("text IS NOT NULL").groupBy("text").agg(F.min("source").alias("source"))


@R("SCO12_age_days", "SELECT id, round(greatest(epoch_us({AS_OF}) - epoch_us(last_confirmed), 0) / 86400000000.0, 6) AS age FROM {CUR} WHERE last_confirmed IS NOT NULL")
def _(s, d):
    return claims(s, d, "last_confirmed").where("last_confirmed IS NOT NULL").select("id", F.round(temporal.age_days(F.col("last_confirmed"), as_of()), 6).alias("age"))


@R("SCO15_sure_recency", """
SELECT id, round(CASE WHEN coalesce(last_confirmed, first_seen) IS NULL THEN 0 ELSE 0.6 * exp(-ln(2) * greatest(epoch_us({AS_OF}) - epoch_us(coalesce(last_confirmed, first_seen)), 0) / 86400000000.0 / 14) END, 6) AS bonus FROM {CUR}""")
def _(s, d):
    return claims(s, d, "last_confirmed", "first_seen").select("id", F.round(temporal.half_life(temporal.age_days(F.coalesce("last_confirmed", "first_seen"), as_of()), 14.0, 0.6), 6).alias("bonus"))


@R("SCO16_enriched_rows", """
SELECT id, at_ts, CASE WHEN at_ts IS NULL THEN 'undated' WHEN age < 1 THEN 'today' WHEN age < 7 THEN 'this_week' WHEN age < 31 THEN 'this_month' ELSE 'older' END AS bucket, round(age, 6) AS age FROM (
SELECT id, coalesce(last_confirmed, first_seen, created_at) AS at_ts, greatest(epoch_us({AS_OF}) - epoch_us(coalesce(last_confirmed, first_seen, created_at)), 0) / 86400000000.0 AS age FROM {CUR})""")
def _(s, d):
    at = F.coalesce("last_confirmed", "first_seen", "created_at")
    age = temporal.age_days(at, as_of())
    return claims(s, d, "last_confirmed", "first_seen", "created_at").select("id", at.alias("at_ts"), temporal.bucket(age).alias("bucket"), F.round(age, 6).alias("age"))


@R("FUN06_interval_days", "SELECT id, round((epoch_us(updated_at) - epoch_us(created_at)) / 86400000000.0, 6) AS days FROM {CUR}")
def _(s, d):
    return claims(s, d, "created_at", "updated_at").select("id", F.round((F.unix_micros("updated_at") - F.unix_micros("created_at")) / 86_400_000_000.0, 6).alias("days"))


@R("FUN18_line_kinds", """
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN starts_with(l, '#') THEN 'header' WHEN regexp_matches(l, '^(- |\\* |• )') THEN 'bullet' WHEN trim(l, ' ') = '' THEN 'blank' ELSE 'other' END AS kind FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents WHERE kind = 'daily_note')) GROUP BY kind""")
def _(s, d):
    line = F.col("l")
    kind = F.when(line.startswith("#"), "header").when(line.rlike(r"^(- |\* |• )"), "bullet").when(F.trim(line) == "", "blank").otherwise("other")
    return table(s, d, "documents").where("kind = 'daily_note'").select(F.explode(F.split("text", "\n")).alias("l")).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@R("FUN28_identity_keys", """
SELECT key, count(*) AS n FROM (SELECT CASE WHEN coalesce(entity, '') <> '' AND coalesce(property, '') <> '' AND coalesce(value, '') <> '' THEN concat_ws('|', 'epv', memory_type, lower(entity), lower(property), lower(value)) WHEN coalesce(text, '') <> '' THEN concat_ws('|', 'text', memory_type, lower(text)) END AS key FROM {CUR}) WHERE key IS NOT NULL GROUP BY key""")
def _(s, d):
    full = F.lit(True)
    for c in ("entity", "property", "value"):
        full = full & (F.coalesce(c, F.lit("")) != "")
    key = F.when(full, F.concat_ws("|", F.lit("epv"), "memory_type", *[F.lower(c) for c in ("entity", "property", "value")])).when(F.coalesce("text", F.lit("")) != "", F.concat_ws("|", F.lit("text"), "memory_type", F.lower("text")))
    return claims(s, d, "memory_type", "entity", "property", "value", "text").select(key.alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@R("FUN35_sigmoid", "SELECT event_id, round(1 / (1 + exp(-value / 100)), 6) AS p FROM events WHERE value IS NOT NULL")
def _(s, d):
    return table(s, d, "events").where("value IS NOT NULL").select("event_id", F.round(1 / (1 + F.exp(-F.col("value") / 100)), 6).alias("p"))


@R("WIN12_log_segments", """
SELECT doc_id, CAST(max(seg) AS BIGINT) AS segments FROM (SELECT doc_id, sum(CASE WHEN starts_with(line, 'PASS ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS seg FROM (
SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE kind = 'build_log' AND text IS NOT NULL))) GROUP BY doc_id""")
def _(s, d):
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = table(s, d, "documents").where("kind = 'build_log' AND text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.withColumn("seg", F.sum(F.col("line").startswith("PASS ").cast("long")).over(w)).groupBy("doc_id").agg(F.max("seg").alias("segments"))


@R("EVA17_hit_by_sessions", "SELECT source_agent, count(DISTINCT source_session) AS sessions, bool_or(memory_type = 'decision') AS hit FROM {CUR} WHERE source_agent IS NOT NULL GROUP BY source_agent")
def _(s, d):
    return claims(s, d, "source_agent", "source_session", "memory_type").where("source_agent IS NOT NULL").groupBy("source_agent").agg(F.count_distinct("source_session").alias("sessions"), F.bool_or(F.col("memory_type") == "decision").alias("hit"))


@R("RPT08_superseded_listing", "SELECT id, status FROM {CUR} WHERE status IN ('superseded', 'archived', 'uncertain') ORDER BY id LIMIT 100")
def _(s, d):
    return claims(s, d, "status").where(F.col("status").isin("superseded", "archived", "uncertain")).orderBy("id").limit(100)


@R("RPT20_file_history", "SELECT file_path, id, updated_at FROM code_chunks QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY updated_at DESC NULLS LAST, id) <= 5")
def _(s, d):
    w = Window.partitionBy("file_path").orderBy(F.desc_nulls_last("updated_at"), "id")
    return table(s, d, "code_chunks").select("file_path", "id", "updated_at").withColumn("r", F.row_number().over(w)).where("r <= 5").drop("r")


@R("RPT33_items_by_file", "SELECT target_file, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'superseded') AS superseded FROM {CUR} WHERE target_file IS NOT NULL GROUP BY target_file")
def _(s, d):
    return claims(s, d, "target_file", "status").where("target_file IS NOT NULL").groupBy("target_file").agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "superseded").alias("superseded"))


@R("RPT35_monthly_topics", """
SELECT month, topic, count(*) AS n FROM (SELECT DISTINCT strftime(captured_at AT TIME ZONE 'UTC', '%Y-%m') AS month, substr(l, 4) AS topic, doc_id FROM (SELECT doc_id, captured_at, unnest(string_split(text, chr(10))) AS l FROM documents WHERE kind = 'daily_note' AND captured_at IS NOT NULL) WHERE starts_with(l, '## ')) GROUP BY ALL""")
def _(s, d):
    lines = table(s, d, "documents").where("kind = 'daily_note' AND captured_at IS NOT NULL").select("doc_id", F.date_format("captured_at", "yyyy-MM").alias("month"), F.explode(F.split("text", "\n")).alias("l")).where(F.col("l").startswith("## "))
    return lines.select("doc_id", "month", F.substr("l", F.lit(4)).alias("topic")).distinct().groupBy("month", "topic").agg(F.count(F.lit(1)).alias("n"))


@R("RPT44_routed_worklist", "SELECT id FROM {CUR} WHERE status = 'active' AND lower(suggested_route) = 'auto'")
def _(s, d):
    return claims(s, d, "status", "suggested_route").where((F.col("status") == "active") & (F.lower("suggested_route") == "auto")).select("id")
