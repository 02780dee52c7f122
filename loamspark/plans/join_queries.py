"""Queries on joins (JON) and the reports that are joins (RPT)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamspark.operators import joins
from loamspark.plans.common import Registry, as_of, claims, feedback
from loamspark.operators.rows import numbered
from loamspark.session import table

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL

_EMB = "(SELECT * FROM code_chunk_embeddings QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC) = 1)"
_SLOT = "coalesce(entity, '') <> '' AND coalesce(property, '') <> ''"


def _current_embeddings(s, d):
    e = table(s, d, "code_chunk_embeddings")
    return e.groupBy("chunk_id").agg(F.max(F.struct("updated_at", "model_name", "embedding")).alias("b")).select("chunk_id", "b.model_name", "b.embedding")


def _conflict_sql(slot: str, where: str = "TRUE") -> str:
    return f"""
WITH r AS (SELECT id, {slot}, coalesce('=' || value, 'null') AS v FROM {{CUR}} WHERE {where}),
c AS (SELECT {slot}, v, count(*) AS n, min(id) AS value_class FROM r GROUP BY ALL),
t AS (SELECT {slot}, sum(n) AS total FROM c GROUP BY ALL HAVING count(*) > 1)
SELECT r.id, {', '.join('r.' + x for x in slot.split(', '))}, c.value_class, CAST(t.total - c.n AS BIGINT) AS conflicting FROM r
JOIN c ON {' AND '.join(f'r.{x} IS NOT DISTINCT FROM c.{x}' for x in [*slot.split(', '), 'v'])} JOIN t ON {' AND '.join(f'r.{x} IS NOT DISTINCT FROM t.{x}' for x in slot.split(', '))}"""


@R("JON01_chunks_with_embeddings", f"SELECT c.id, c.chunk_type, e.model_name FROM code_chunks c JOIN {_EMB} e ON c.id = e.chunk_id")
def _(s, d):
    return table(s, d, "code_chunks").select("id", "chunk_type").join(_current_embeddings(s, d).select(F.col("chunk_id").alias("id"), "model_name"), "id")


@R("JON04_slot_conflicts", _conflict_sql("entity, property, scope", _SLOT))
def _(s, d):
    return joins.conflicts(claims(s, d, "entity", "property", "scope", "value").where(_SLOT), ["entity", "property", "scope"], "value", "id")


@R("JON10_items_missing_in_graph", "SELECT id FROM {CUR} WHERE status = 'active' AND id NOT IN (SELECT id FROM neo4j_nodes WHERE id IS NOT NULL)")
def _(s, d):
    return claims(s, d, "status").where("status = 'active'").select("id").join(table(s, d, "neo4j_nodes").select("id"), "id", "left_anti")


@R("JON11_chunks_without_embedding", "SELECT id FROM code_chunks WHERE id NOT IN (SELECT chunk_id FROM code_chunk_embeddings WHERE chunk_id IS NOT NULL)")
def _(s, d):
    return table(s, d, "code_chunks").select("id").join(table(s, d, "code_chunk_embeddings").select(F.col("chunk_id").alias("id")), "id", "left_anti")


@R("JON13_present_anywhere", "SELECT item_id FROM parity_issue WHERE item_id IN (SELECT id FROM memory_items UNION ALL SELECT id FROM memory_discarded UNION ALL SELECT id FROM neo4j_nodes)")
def _(s, d):
    ids = None
    for t in ("memory_items", "memory_discarded", "neo4j_nodes"):
        part = table(s, d, t).select(F.col("id").alias("item_id"))
        ids = part if ids is None else ids.unionByName(part)
    return table(s, d, "parity_issue").select("item_id").join(ids, "item_id", "left_semi")


_DIS = """(SELECT id, coalesce(payload->>'$.text', payload->>'$.normalized_text') AS text, payload->>'$.entity' AS entity, payload->>'$.property' AS property, payload->>'$.value' AS value,
 TRY_CAST(payload->>'$.confidence' AS DOUBLE) AS confidence FROM (SELECT DISTINCT id, payload FROM memory_discarded WHERE json_valid(payload)))"""


def _discards(s, d):
    p = table(s, d, "memory_discarded").select("id", "payload").distinct().select("id", F.try_parse_json("payload").alias("p")).where("p IS NOT NULL")
    get = lambda k: F.try_variant_get("p", f"$.{k}", "string")
    return p.select("id", F.coalesce(get("text"), get("normalized_text")).alias("text"), get("entity").alias("entity"), get("property").alias("property"), get("value").alias("value"), get("confidence").try_cast("double").alias("confidence"))


@R("JON15_rejected_texts", """
WITH c AS (SELECT DISTINCT lower(text) AS t FROM {CUR} WHERE text IS NOT NULL)
SELECT c.t AS text, count(*) AS n, CASE WHEN bool_or(x.confidence IS NULL) THEN NULL ELSE max(x.confidence) END AS prior FROM c JOIN """ + _DIS + """ x ON md5(c.t) = md5(lower(x.text)) AND c.t = lower(x.text) GROUP BY c.t""")
def _(s, d):
    c = claims(s, d, "text").where("text IS NOT NULL").select(F.lower("text").alias("t")).distinct()
    x = _discards(s, d).select(F.lower("text").alias("t"), "confidence")
    prior = F.when(F.bool_or(F.col("confidence").isNull()), None).otherwise(F.max("confidence"))
    return c.join(x.groupBy("t").agg(F.count(F.lit(1)).alias("n"), prior.alias("prior")), "t").select(F.col("t").alias("text"), "n", "prior")


@R("JON16_rejected_slots", """
WITH c AS (SELECT DISTINCT entity, property, value FROM {CUR} WHERE entity IS NOT NULL AND property IS NOT NULL AND value IS NOT NULL)
SELECT c.entity, c.property, c.value, count(*) AS n, CASE WHEN bool_or(x.confidence IS NULL) THEN NULL ELSE max(x.confidence) END AS prior FROM c JOIN """ + _DIS + """ x USING (entity, property, value) GROUP BY ALL""")
def _(s, d):
    c = claims(s, d, "entity", "property", "value").dropna(subset=["entity", "property", "value"]).select("entity", "property", "value").distinct()
    prior = F.when(F.bool_or(F.col("confidence").isNull()), None).otherwise(F.max("confidence"))
    x = _discards(s, d).groupBy("entity", "property", "value").agg(F.count(F.lit(1)).alias("n"), prior.alias("prior"))
    return c.join(x, ["entity", "property", "value"])


@R("JON18_line_to_chunk", """
WITH p AS (SELECT id AS error_id, file_path, line_start + 3 AS line FROM code_chunks)
SELECT p.error_id, p.line, c.id AS chunk_id FROM p JOIN code_chunks c ON p.file_path = c.file_path AND p.line BETWEEN c.line_start AND c.line_end
QUALIFY row_number() OVER (PARTITION BY p.error_id ORDER BY c.line_end - c.line_start + CASE WHEN c.chunk_type = 'module' THEN 100000 ELSE 0 END, c.id) = 1""")
def _(s, d):
    c = table(s, d, "code_chunks").select("id", "file_path", "chunk_type", "line_start", "line_end")
    p = c.select(F.col("id").alias("error_id"), "file_path", (F.col("line_start") + 3).alias("line"))
    span = F.col("line_end") - F.col("line_start") + F.when(F.col("chunk_type") == "module", 100000).otherwise(0)
    return joins.point_in_range(p, c, ["file_path"], "line", "line_start", "line_end", "error_id", [span, F.col("id")], 128).select("error_id", "line", F.col("id").alias("chunk_id"))


@R("JON21_context_window", """
WITH t AS {TURNS}, hit AS (SELECT session_id, min(turn_index) - 1 AS lo, max(turn_index) + 1 AS hi FROM t WHERE contains(text, 'container') GROUP BY session_id)
SELECT t.session_id, t.turn_index, coalesce(contains(t.text, 'container'), FALSE) AS matched FROM t JOIN hit USING (session_id) WHERE t.turn_index BETWEEN hit.lo AND hit.hi""")
def _(s, d):
    t = turns(s, d).withColumn("matched", F.coalesce(F.contains("text", F.lit("container")), F.lit(False)))
    hit = t.where("matched").groupBy("session_id").agg((F.min("turn_index") - 1).alias("lo"), (F.max("turn_index") + 1).alias("hi"))
    return t.join(hit, "session_id").where("turn_index BETWEEN lo AND hi").select("session_id", "turn_index", "matched")


def turns(s, d):
    """Documents of a source as the turns of a session, numbered in order; a hot source is numbered in parts."""
    t = table(s, d, "documents").select("doc_id", F.col("source").alias("session_id"), "text")
    return numbered(t, "session_id", "doc_id", "turn_index")


@R("JON24_corroboration", """
SELECT lower(text) AS text, count(*) AS n, count(DISTINCT source_agent) AS agents, min(first_seen) AS first_seen, max(last_confirmed) AS last_confirmed FROM {CUR} WHERE text IS NOT NULL GROUP BY lower(text)""")
def _(s, d):
    c = claims(s, d, "text", "source_agent", "first_seen", "last_confirmed").where("text IS NOT NULL")
    return c.groupBy(F.lower("text").alias("text")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_agent").alias("agents"), F.min("first_seen").alias("first_seen"), F.max("last_confirmed").alias("last_confirmed"))


@R("JON25_near_in_time", """
SELECT id, scope, count(*) OVER (PARTITION BY scope ORDER BY epoch(first_seen)::BIGINT RANGE BETWEEN 172800 PRECEDING AND CURRENT ROW) - 1 AS before FROM (SELECT id, scope, date_trunc('second', first_seen) AS first_seen FROM {CUR} WHERE first_seen IS NOT NULL)""")
def _(s, d):
    return joins.near_in_time(claims(s, d, "scope", "first_seen"), "scope", "first_seen", "id", 48 * 3600)


@R("JON26_adjacent_versions", """
SELECT id, older_id, CASE WHEN value IS DISTINCT FROM older_value THEN 'SUPERSEDES' ELSE 'RELATES_TO' END AS link FROM (
SELECT id, value, lead(id) OVER w AS older_id, lead(value) OVER w AS older_value FROM {CUR} WHERE coalesce(entity, '') <> '' AND coalesce(property, '') <> ''
WINDOW w AS (PARTITION BY entity, property ORDER BY first_seen DESC NULLS LAST, id)) WHERE older_id IS NOT NULL""")
def _(s, d):
    w = Window.partitionBy("entity", "property").orderBy(F.desc_nulls_last("first_seen"), "id")
    c = claims(s, d, "entity", "property", "value", "first_seen").where(_SLOT)
    c = c.select("id", "value", F.lead("id").over(w).alias("older_id"), F.lead("value").over(w).alias("older_value")).where("older_id IS NOT NULL")
    return c.select("id", "older_id", F.when(~F.col("value").eqNullSafe(F.col("older_value")), "SUPERSEDES").otherwise("RELATES_TO").alias("link"))


@R("JON27_explicit_supersedes", "SELECT a.id, a.supersedes FROM {CUR} a WHERE a.supersedes IN (SELECT id FROM {CUR})")
def _(s, d):
    c = claims(s, d, "supersedes")
    return c.where("supersedes IS NOT NULL").join(c.select(F.col("id").alias("supersedes")), "supersedes", "left_semi").select("id", "supersedes")


@R("JON28_superseded_by", "SELECT c.id, count(n.id) AS newer FROM {CUR} c LEFT JOIN {CUR} n ON n.supersedes = c.id GROUP BY c.id")
def _(s, d):
    c = claims(s, d, "supersedes")
    newer = c.where("supersedes IS NOT NULL").groupBy(F.col("supersedes").alias("id")).agg(F.count(F.lit(1)).alias("newer"))
    return c.select("id").join(newer, "id", "left").select("id", F.coalesce("newer", F.lit(0)).alias("newer"))


@R("JON29_as_of", """
SELECT entity, property, id, value FROM {CUR} WHERE coalesce(entity, '') <> '' AND coalesce(property, '') <> '' AND first_seen <= TIMESTAMPTZ '2025-12-31 00:00:00+00'
QUALIFY row_number() OVER (PARTITION BY entity, property ORDER BY first_seen DESC, id DESC) = 1""")
def _(s, d):
    c = claims(s, d, "entity", "property", "value", "first_seen").where(_SLOT).select("entity", "property", "id", "value", "first_seen")
    return joins.as_of_rows(c, ["entity", "property"], "first_seen", F.lit("2025-12-31 00:00:00").cast("timestamp"), "id").drop("first_seen")


@R("JON32_snapshot_diff", """
WITH o AS (SELECT file_path, min(file_hash) AS h FROM code_chunks WHERE chunk_type <> 'class' GROUP BY file_path), n AS (SELECT file_path, max(file_hash) AS h FROM code_chunks WHERE chunk_type <> 'function' GROUP BY file_path)
SELECT coalesce(o.file_path, n.file_path) AS file_path, CASE WHEN o.file_path IS NULL THEN 'added' WHEN n.file_path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.file_path = n.file_path
WHERE o.file_path IS NULL OR n.file_path IS NULL OR o.h IS DISTINCT FROM n.h""")
def _(s, d):
    c = table(s, d, "code_chunks")
    old = c.where("chunk_type <> 'class'").groupBy("file_path").agg(F.min("file_hash").alias("h"))
    new = c.where("chunk_type <> 'function'").groupBy("file_path").agg(F.max("file_hash").alias("h"))
    return joins.snapshot_diff(old, new, "file_path", "h")


@R("JON20_recent_touching", "SELECT DISTINCT file_path, updated_at FROM code_chunks WHERE file_path IN (SELECT file_path FROM code_chunks WHERE chunk_type = 'class') ORDER BY updated_at DESC, file_path LIMIT 5")
def _(s, d):
    c = table(s, d, "code_chunks")
    return c.join(c.where("chunk_type = 'class'").select("file_path"), "file_path", "left_semi").select("file_path", "updated_at").distinct().orderBy(F.desc("updated_at"), "file_path").limit(5)


@R("RPT01_drill_down", """
WITH g AS (SELECT source_session, list(id ORDER BY id)[1:5] AS ids FROM {CUR} WHERE source_session IS NOT NULL GROUP BY source_session), x AS (SELECT source_session, unnest(ids) AS id FROM g)
SELECT x.source_session, c.id, c.first_seen FROM x JOIN {CUR} c ON x.id = c.id""")
def _(s, d):
    c = claims(s, d, "source_session", "first_seen").where("source_session IS NOT NULL")
    w = Window.partitionBy("source_session").orderBy("id")
    return c.withColumn("r", F.row_number().over(w)).where("r <= 5").select("source_session", "id", "first_seen")


@R("RPT03_conflict_candidates", _conflict_sql("memory_type, entity, property, scope", "status = 'active'"))
def _(s, d):
    c = claims(s, d, "memory_type", "entity", "property", "scope", "value", "status").where("status = 'active'")
    return joins.conflicts(c, ["memory_type", "entity", "property", "scope"], "value", "id")


@R("RPT06_recent_writes", "SELECT id, coalesce(last_confirmed, first_seen, created_at) AS at_ts FROM {CUR} WHERE status IN ('active', 'superseded', 'archived', 'uncertain') ORDER BY at_ts DESC NULLS LAST, id LIMIT 30")
def _(s, d):
    c = claims(s, d, "status", "last_confirmed", "first_seen", "created_at").where(F.col("status").isin("active", "superseded", "archived", "uncertain"))
    return c.select("id", F.coalesce("last_confirmed", "first_seen", "created_at").alias("at_ts")).orderBy(F.desc_nulls_last("at_ts"), "id").limit(30)


@R("RPT07_review_queues", """
SELECT suggested_route, id, preview FROM (SELECT suggested_route, id, CASE WHEN length(t) > 160 THEN substr(t, 1, 157) || '...' ELSE t END AS preview, row_number() OVER (PARTITION BY suggested_route ORDER BY created_at DESC, id) AS r
FROM (SELECT *, trim(replace(text, chr(10), ' ')) AS t FROM {CUR} WHERE suggested_route IS NOT NULL)) WHERE r <= 10""")
def _(s, d):
    t = F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))
    w = Window.partitionBy("suggested_route").orderBy(F.desc("created_at"), "id")
    c = claims(s, d, "suggested_route", "text", "created_at").where("suggested_route IS NOT NULL").withColumns({"t": t, "r": F.row_number().over(w)}).where("r <= 10")
    return c.select("suggested_route", "id", F.when(F.length("t") > 160, F.concat(F.substring("t", 1, 157), F.lit("..."))).otherwise(F.col("t")).alias("preview"))


@R("RPT16_lines_already_known", "SELECT DISTINCT a.line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE kind = 'daily_note') a WHERE length(a.line) > 20 AND a.line IN (SELECT unnest(string_split(text, chr(10))) FROM documents WHERE kind = 'summary')")
def _(s, d):
    lines = lambda kind: table(s, d, "documents").where(F.col("kind") == kind).select(F.explode(F.split("text", "\n")).alias("line")).where("length(line) > 20").distinct()
    return lines("daily_note").join(lines("summary"), "line", "left_semi")


@R("AGG11_top_retrieved", """
SELECT selected_id, count(*) AS n, count(*) FILTER (operator_feedback = 'useful') AS useful, count(*) FILTER (operator_feedback = 'bad') AS bad FROM {FB} GROUP BY selected_id ORDER BY n DESC, selected_id LIMIT 20""")
def _(s, d):
    f = feedback(s, d).groupBy("selected_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("operator_feedback") == "useful").alias("useful"), F.count_if(F.col("operator_feedback") == "bad").alias("bad"))
    return f.orderBy(F.desc("n"), "selected_id").limit(20)


@R("JON23_issues_of_items", "SELECT i.item_id, i.issue_type, c.text FROM parity_issue i JOIN {CUR} c ON i.item_id = c.id")
def _(s, d):
    return table(s, d, "parity_issue").select(F.col("item_id").alias("id"), "issue_type").join(claims(s, d, "text"), "id").select(F.col("id").alias("item_id"), "issue_type", "text")


@R("STR13_above_high_water_mark", "SELECT id FROM {CUR} WHERE created_at > {AS_OF} - INTERVAL 120 DAY")
def _(s, d):
    return claims(s, d, "created_at").where(F.col("created_at") > as_of() - F.expr("INTERVAL 120 DAYS")).select("id")
