"""Further queries on joins, aggregations, ordered text and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamspark.functions import dates
from loamspark.operators import retrieval, selection, store, temporal
from loamspark.plans.common import Registry, as_of, claims, feedback
from loamspark.plans.join_queries import turns
from loamspark.plans.retrieval_queries import TERMS
from loamspark.session import table

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL
_TOK = "list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9_ ]', ' ', 'g'), ' +'), lambda x: x <> '')"


@R("SNK04_upsert_composite_key", """
WITH o AS (SELECT entity, property, max(confidence) AS confidence FROM {CUR} WHERE memory_type <> 'fact' GROUP BY ALL), n AS (SELECT entity, property, min(importance) AS confidence FROM {CUR} WHERE memory_type = 'fact' GROUP BY ALL)
SELECT CASE WHEN n.hit THEN n.entity ELSE o.entity END AS entity, CASE WHEN n.hit THEN n.property ELSE o.property END AS property, CASE WHEN n.hit THEN n.confidence ELSE o.confidence END AS confidence
FROM o FULL JOIN (SELECT *, TRUE AS hit FROM n) n ON o.entity IS NOT DISTINCT FROM n.entity AND o.property IS NOT DISTINCT FROM n.property""")
def _(s, d):
    c = claims(s, d, "entity", "property", "confidence", "importance", "memory_type")
    old = c.where("memory_type <> 'fact'").groupBy("entity", "property").agg(F.max("confidence").alias("confidence"))
    new = c.where("memory_type = 'fact'").groupBy("entity", "property").agg(F.min("importance").alias("confidence"))
    return store.upsert(old, new, ["entity", "property"])


@R("SNK10_summary_all_items", "SELECT source_session, id, count(*) OVER (PARTITION BY source_session) AS n, max(last_confirmed) OVER (PARTITION BY source_session) AS last_confirmed FROM {CUR} WHERE source_session IS NOT NULL")
def _(s, d):
    """Every claim of each session with its session's summary; the id list is kept as rows, so a session may hold any share of them."""
    c = claims(s, d, "source_session", "last_confirmed").where("source_session IS NOT NULL")
    summary = c.groupBy("source_session").agg(F.count(F.lit(1)).alias("n"), F.max("last_confirmed").alias("last_confirmed"))
    return c.select("source_session", "id").join(summary, "source_session")


@R("JON02_terms_times_items", "SELECT t.term, count(*) AS n FROM {CUR} c, (SELECT unnest(['compiler', 'snapshot', 'warnings']) AS term) t WHERE contains(lower(c.text), t.term) GROUP BY t.term")
def _(s, d):
    terms = F.array(*[F.lit(t) for t in ("compiler", "snapshot", "warnings")])
    held = claims(s, d, "text").select(F.explode(F.filter(terms, lambda t: F.contains(F.lower("text"), t))).alias("term"))
    return held.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@R("JON14_existing_ids", "SELECT id FROM neo4j_nodes WHERE id IN (SELECT id FROM memory_items UNION ALL SELECT coalesce(payload->>'$.id', payload->>'$.memory_id') FROM qdrant_points)")
def _(s, d):
    p = table(s, d, "qdrant_points").select(F.coalesce(F.get_json_object("payload", "$.id"), F.get_json_object("payload", "$.memory_id")).alias("id"))
    return table(s, d, "neo4j_nodes").select("id").join(table(s, d, "memory_items").select("id").unionByName(p), "id", "left_semi")


@R("JON19_chunks_over_lines", "SELECT DISTINCT c.file_path FROM code_chunks c JOIN (SELECT file_path, max(line_start) AS line FROM code_chunks WHERE chunk_type = 'method' GROUP BY file_path) e ON c.file_path = e.file_path WHERE c.chunk_type = 'class' AND e.line BETWEEN c.line_start AND c.line_end")
def _(s, d):
    c = table(s, d, "code_chunks").select("file_path", "chunk_type", "line_start", "line_end")
    e = c.where("chunk_type = 'method'").groupBy("file_path").agg(F.max("line_start").alias("line"))
    return c.where("chunk_type = 'class'").join(e, "file_path").where("line BETWEEN line_start AND line_end").select("file_path").distinct()


@R("JON22_window_per_hit", "WITH t AS {TURNS} SELECT h.doc_id, count(*) AS n FROM t h JOIN t ON t.session_id = h.session_id AND t.turn_index >= h.turn_index - 2 AND t.turn_index < h.turn_index + 2 WHERE contains(h.text, 'compiler') GROUP BY h.doc_id")
def _(s, d):
    w = Window.partitionBy("session_id").orderBy("turn_index").rangeBetween(-2, 1)
    t = turns(s, d).withColumn("n", F.count(F.lit(1)).over(w))
    return t.where(F.contains("text", F.lit("compiler"))).select("doc_id", "n")


@R("JON33_index_reconcile", """
WITH i AS (SELECT DISTINCT file_path, file_hash FROM code_chunks WHERE chunk_type = 'function'), n AS (SELECT file_path, min(file_hash) AS file_hash FROM code_chunks GROUP BY file_path)
SELECT n.file_path, CASE WHEN count(i.file_hash) = 0 THEN 'missing' WHEN bool_or(i.file_hash = n.file_hash) THEN 'current' ELSE 'stale' END AS state FROM n LEFT JOIN i ON n.file_path = i.file_path GROUP BY n.file_path, n.file_hash""")
def _(s, d):
    c = table(s, d, "code_chunks")
    i = c.where("chunk_type = 'function'").select("file_path", F.col("file_hash").alias("h")).distinct()
    n = c.groupBy("file_path").agg(F.min("file_hash").alias("file_hash"))
    j = n.join(i, "file_path", "left").groupBy("file_path").agg(F.count("h").alias("k"), F.coalesce(F.bool_or(F.col("h") == F.col("file_hash")), F.lit(False)).alias("same"))
    return j.select("file_path", F.when(F.col("k") == 0, "missing").when(F.col("same"), "current").otherwise("stale").alias("state"))


@R("AGG09_item_feedback", "SELECT selected_id, count(*) AS n, count(operator_feedback) AS marked, max(feedback_at) AS last_at FROM {FB} GROUP BY selected_id")
def _(s, d):
    return feedback(s, d).groupBy("selected_id").agg(F.count(F.lit(1)).alias("n"), F.count("operator_feedback").alias("marked"), F.max("feedback_at").cast("timestamp_ntz").alias("last_at"))


@R("AGG10_nested_considered", "SELECT tag, count(*) AS n, round(avg(confidence), 4) AS mean FROM (SELECT unnest(tags) AS tag, confidence FROM {CUR}) WHERE tag IS NOT NULL GROUP BY tag")
def _(s, d):
    return claims(s, d, "tags", "confidence").select(F.explode("tags").alias("tag"), "confidence").where("tag IS NOT NULL").groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("mean"))


@R("AGG26_day_representatives", """
SELECT day, id, confidence FROM (SELECT strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, id, confidence FROM {CUR} WHERE created_at IS NOT NULL AND text IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY day ORDER BY confidence DESC NULLS LAST, id) <= 3""")
def _(s, d):
    w = Window.partitionBy("day").orderBy(F.desc_nulls_last("confidence"), "id")
    c = claims(s, d, "created_at", "text", "confidence").where("created_at IS NOT NULL AND text IS NOT NULL").withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    return c.withColumn("r", F.row_number().over(w)).where("r <= 3").select("day", "id", "confidence")


@R("AGG39_maintenance_sections", """
SELECT 'undated' AS section, count(*) AS n FROM {CUR} WHERE last_confirmed IS NULL AND first_seen IS NULL UNION ALL SELECT 'unplaced', count(*) FROM {CUR} WHERE coalesce(entity, '') = '' OR coalesce(property, '') = ''
UNION ALL SELECT 'stale', count(*) FROM {CUR} WHERE freshness_class = 'volatile' AND last_confirmed < {AS_OF} - INTERVAL 30 DAY""")
def _(s, d):
    c = claims(s, d, "entity", "property", "last_confirmed", "first_seen", "freshness_class")
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    tests = {"undated": F.col("last_confirmed").isNull() & F.col("first_seen").isNull(), "unplaced": blank("entity") | blank("property"), "stale": (F.col("freshness_class") == "volatile") & (F.col("last_confirmed") < as_of() - F.expr("INTERVAL 30 DAYS"))}
    one = c.agg(*[F.count_if(v).alias(k) for k, v in tests.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("section"), F.col(k).alias("n")) for k in tests])))


@R("FUN32_test_lines", r"""
SELECT name, count(*) AS n, round(sum(CAST(secs AS DOUBLE)), 3) AS total FROM (SELECT regexp_extract(l, '^PASS (\S+) .*\t(\d+\.\d+) s', 1) AS name, regexp_extract(l, '^PASS (\S+) .*\t(\d+\.\d+) s', 2) AS secs FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents WHERE kind = 'build_log')) WHERE name <> '' GROUP BY name""")
def _(s, d):
    p = r"^PASS (\S+) .*\t(\d+\.\d+) s"
    lines = table(s, d, "documents").where("kind = 'build_log'").select(F.explode(F.split("text", "\n")).alias("l")).where(F.col("l").rlike(p))
    return lines.groupBy(F.regexp_extract("l", p, 1).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.regexp_extract("l", p, 2).cast("double")), 3).alias("total"))


@R("FUN34_topics", "SELECT topic, count(*) AS n FROM (SELECT lower(trim(regexp_replace(l, '^#+ ', ''), ' ')) AS topic FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents WHERE kind = 'daily_note') WHERE starts_with(l, '## ')) GROUP BY topic")
def _(s, d):
    lines = table(s, d, "documents").where("kind = 'daily_note'").select(F.explode(F.split("text", "\n")).alias("l")).where(F.col("l").startswith("## "))
    return lines.groupBy(F.lower(F.trim(F.regexp_replace("l", "^#+ ", ""))).alias("topic")).agg(F.count(F.lit(1)).alias("n"))


@R("FUN38_json_functions", "SELECT event_id, TRY_CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@R("FUN39_role_segments", r"""
SELECT role, count(*) AS n, CAST(sum(length(body)) AS BIGINT) AS chars FROM (SELECT regexp_extract(p, '^(USER|ASSISTANT): ', 1) AS role, regexp_replace(p, '^(USER|ASSISTANT): ', '') AS body FROM (
SELECT unnest(string_split(text, chr(10) || chr(10))) AS p FROM documents WHERE kind = 'transcript')) WHERE role <> '' GROUP BY role""")
def _(s, d):
    p = "^(USER|ASSISTANT): "
    seg = table(s, d, "documents").where("kind = 'transcript'").select(F.explode(F.split("text", "\n\n")).alias("p")).where(F.col("p").rlike(p))
    return seg.groupBy(F.regexp_extract("p", p, 1).alias("role")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.regexp_replace("p", p, ""))).alias("chars"))


@R("SCO20_fused_sources", """
SELECT id, round(sum(s), 6) AS score FROM (SELECT id, coalesce(confidence, 0) + 0.10 AS s FROM {CUR} WHERE project_id = 'atlas' UNION ALL SELECT id, coalesce(confidence, 0) * 0.55 FROM (SELECT DISTINCT id, confidence FROM neo4j_nodes) WHERE confidence > 0.8) GROUP BY id""")
def _(s, d):
    a = claims(s, d, "project_id", "confidence").where("project_id = 'atlas'").select("id", (F.coalesce("confidence", F.lit(0.0)) + 0.10).alias("s"))
    b = table(s, d, "neo4j_nodes").select("id", "confidence").distinct().where("confidence > 0.8").select("id", (F.col("confidence") * 0.55).alias("s"))
    return a.unionByName(b).groupBy("id").agg(F.round(F.sum("s"), 6).alias("score"))


@R("EVA09_ablation", "SELECT round(avg(b.value - a.value), 6) AS mean_change, count(*) AS n FROM (SELECT user_id, avg(value) AS value FROM events WHERE event_type = 'view' GROUP BY user_id) a JOIN (SELECT user_id, avg(value) AS value FROM events WHERE event_type = 'click' GROUP BY user_id) b USING (user_id)")
def _(s, d):
    of = lambda k, n: table(s, d, "events").where(F.col("event_type") == k).groupBy("user_id").agg(F.avg("value").alias(n))
    return of("view", "a").join(of("click", "b"), "user_id").agg(F.round(F.avg(F.col("b") - F.col("a")), 6).alias("mean_change"), F.count(F.lit(1)).alias("n"))


@R("STR14_last_loaded", "SELECT source_agent, max(created_at) AS newest, max(created_at) > {AS_OF} - INTERVAL 60 DAY AS behind FROM {CUR} WHERE source_agent IS NOT NULL GROUP BY source_agent")
def _(s, d):
    c = claims(s, d, "source_agent", "created_at").where("source_agent IS NOT NULL").groupBy("source_agent").agg(F.max("created_at").alias("newest"))
    return c.withColumn("behind", F.col("newest") > as_of() - F.expr("INTERVAL 60 DAYS"))


@R("RPT10_previews", "SELECT doc_id, CASE WHEN length(t) > 80 THEN substr(t, 1, 77) || '...' ELSE t END AS preview FROM (SELECT doc_id, trim(replace(text, chr(10), ' '), ' ') AS t FROM documents WHERE text IS NOT NULL)")
def _(s, d):
    t = F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", t.alias("t")).select("doc_id", F.when(F.length("t") > 80, F.concat(F.substring("t", 1, 77), F.lit("..."))).otherwise(F.col("t")).alias("preview"))


@R("RPT32_transcript_profile", "SELECT kind, count(*) AS n, count(text) AS with_text, max(length(text)) AS longest FROM documents GROUP BY kind")
def _(s, d):
    return table(s, d, "documents").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("with_text"), F.max(F.length("text")).alias("longest"))


@R("RPT34_bullets_under_headings", r"""
SELECT doc_id, pos, heading, line FROM (SELECT doc_id, pos, line, last_value(CASE WHEN starts_with(line, '## ') THEN substr(line, 4) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM (
SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE kind = 'daily_note' AND text IS NOT NULL))) WHERE starts_with(line, '- ')""")
def _(s, d):
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = table(s, d, "documents").where("kind = 'daily_note' AND text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    head = F.last(F.when(F.col("line").startswith("## "), F.substr("line", F.lit(4))), ignorenulls=True).over(w)
    return lines.withColumn("heading", head).where(F.col("line").startswith("- ")).select("doc_id", "pos", "heading", "line")


@R("TOP10_greedy_packet")
def _(s, d):
    """For each project the best claims that fit 8 items and 300 tokens, without near-duplicates."""
    c = claims(s, d, "project_id", "text", "confidence").where("project_id IS NOT NULL")
    return selection.greedy_packet(c.withColumn("score", F.coalesce("confidence", F.lit(0.0))), "project_id", "id", "text", "score", 50, 8, 300)


@R("GRA08_budgeted_context", """
SELECT source_session, id, spent FROM (SELECT source_session, id, CAST(sum(greatest(1, length(coalesce(text, '')) // 4)) OVER (PARTITION BY source_session ORDER BY confidence DESC NULLS LAST, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS spent
FROM {CUR} WHERE source_session IS NOT NULL) WHERE spent <= 200""")
def _(s, d):
    cost = F.greatest(F.lit(1), F.floor(F.length(F.coalesce("text", F.lit(""))) / 4))
    c = claims(s, d, "source_session", "text", "confidence").where("source_session IS NOT NULL")
    return selection.within_budget(c, "source_session", [F.desc_nulls_last("confidence"), F.col("id")], cost, 200).select("source_session", "id", "spent")


@R("FUN08_temporal_queries", r"""
SELECT item_id, hits >= 2 OR hits / greatest(len(regexp_extract_all(question, '\S+')), 1) > 0.12 AS temporal FROM (SELECT item_id, question, len(regexp_extract_all(lower(question), '\b(when|today|yesterday|recent(ly)?|latest|last|ago|before|after|since|until|week|month|year|day)\b')) AS hits FROM eval_items)""")
def _(s, d):
    return table(s, d, "eval_items").select("item_id", dates.is_temporal(F.col("question")).alias("temporal"))


@R("UDF01_hashed_vectors")
def _(s, d):
    """Embeddings of the claims by token hashing; tested for norm and equality."""
    return retrieval.hashed_vectors(claims(s, d, "text"), "id", "text", 64)


@R("JON30_code_references", r"""
WITH n AS (SELECT DISTINCT id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_.]{5,}'))) AS name FROM {CUR} WHERE text IS NOT NULL),
k AS (SELECT DISTINCT lower(module_name) AS name, file_path, 0.6 AS w, 'module' AS reason FROM code_chunks WHERE module_name IS NOT NULL UNION ALL SELECT DISTINCT lower(class_name), file_path, 0.8, 'class' FROM code_chunks WHERE class_name IS NOT NULL)
SELECT n.id, k.file_path, round(sum(k.w), 6) AS confidence, list_sort(list(DISTINCT k.reason)) AS reasons FROM n JOIN k USING (name) GROUP BY n.id, k.file_path""")
def _(s, d):
    names = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z0-9_.]{5,}"), F.lit(0)))
    n = claims(s, d, "text").where("text IS NOT NULL").select("id", F.explode(names).alias("name"))
    c = table(s, d, "code_chunks")
    of = lambda col, w, why: c.where(F.col(col).isNotNull()).select(F.lower(col).alias("name"), "file_path").distinct().withColumns({"w": F.lit(w), "reason": F.lit(why)})
    k = of("module_name", 0.6, "module").unionByName(of("class_name", 0.8, "class"))
    return n.join(k, "name").groupBy("id", "file_path").agg(F.round(F.sum("w"), 6).alias("confidence"), F.array_sort(F.collect_set("reason")).alias("reasons"))  # two reasons


@R("STR05_file_changes", """
SELECT file_path, CASE WHEN o.h IS NULL THEN 'fresh' WHEN n.size < o.size THEN 'truncated' WHEN n.h <> o.h THEN 'rotated' WHEN n.size = o.size THEN 'unchanged' ELSE 'append' END AS change
FROM (SELECT file_path, max(line_end) AS size, max(file_hash) AS h FROM code_chunks GROUP BY file_path) n LEFT JOIN (SELECT file_path, max(line_end) AS size, max(file_hash) AS h FROM code_chunks WHERE chunk_type <> 'method' GROUP BY file_path) o USING (file_path)""")
def _(s, d):
    snap = lambda c: c.groupBy("file_path").agg(F.max("line_end").alias("size"), F.max("file_hash").alias("h"))
    c = table(s, d, "code_chunks")
    o = snap(c.where("chunk_type <> 'method'")).select("file_path", F.col("size").alias("was"), F.col("h").alias("old"))
    j = snap(c).join(o, "file_path", "left")
    # one inode throughout: a changed head tells a rotated file
    same = F.when(F.col("old").isNotNull(), F.lit(1))
    return j.select("file_path", selection.file_change(same, F.col("was"), F.lit(1), F.col("size"), F.col("h") == F.col("old")).alias("change"))
