"""Reports, sources and queues as queries (RPT, SRC, STR, SCO20-29, WIN14)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from loamspark.functions import dates
from loamspark.operators import retrieval, store
from loamspark.plans.common import AS_OF, Registry, as_of, claims
from loamspark.plans.link_queries import _vec_sql, nearest_texts
from loamspark.plans.stream_queries import _drain
from loamspark.plans.text_queries import SQL as _TEXT_SQL
from loamspark.plans.text_queries import QUERIES as _TEXT
from loamspark.session import scratch, table
from loamspark.sources import files
from loamspark.streaming import events as ev
from loamspark.streaming import queue

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL

ASKED = ["snapshot", "owner", "policy"]
_HITS = " + ".join(f"CAST(contains(lower({{0}}), '{t}') AS INT)" for t in ASKED)


def contained(text: str, words: list[str]):
    """How many of the words a text holds as substrings, in any case."""
    return sum((F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(w)).cast("int") for w in words), F.lit(0))


@R("SCO21_project_line_score", "SELECT doc_id, pos, round(0.3 * hits + CASE kind WHEN 'handoff' THEN 0.12 WHEN 'summary' THEN 0.07 ELSE 0.03 END, 6) AS score FROM (SELECT doc_id, kind, pos, " + _HITS.format("line") + " AS hits FROM (SELECT doc_id, kind, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE kind IN ('handoff', 'summary', 'daily_note') AND text IS NOT NULL)) WHERE hits > 0")
def _(s, d):
    """Lines of project notes: .3 for each word asked for, and a prior of the source (here handoffs are current, summaries milestones)."""
    t = table(s, d, "documents").where("kind IN ('handoff', 'summary', 'daily_note') AND text IS NOT NULL")
    prior = F.when(F.col("kind") == "handoff", 0.12).when(F.col("kind") == "summary", 0.07).otherwise(0.03)
    lines = t.select("doc_id", "kind", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("hits", contained("line", ASKED)).where("hits > 0")
    return lines.select("doc_id", "pos", F.round(0.3 * F.col("hits") + prior, 6).alias("score"))


@R("SCO22_insight_scores", "SELECT id, " + _HITS.format("text") + " AS score FROM {CUR} WHERE text IS NOT NULL")
def _(s, d):
    return claims(s, d, "text").where("text IS NOT NULL").select("id", contained("text", ASKED).alias("score"))


def _specificity(text):
    """How specific a text is: a number, a technical word, a word of state, and its length."""
    t = F.lower(text)
    any_of = lambda ws: F.expr("false") if not ws else sum((F.contains(t, F.lit(w)).cast("int") for w in ws), F.lit(0)) > 0
    part = lambda c: F.when(c, 0.2).otherwise(0.0)
    return part(t.rlike(r"\b\d+\b")) + part(any_of(_TECHNICAL)) + part(any_of(_STATE)) + F.least(F.length(text) / 300.0, F.lit(0.4))


# Fixed values.
_TECHNICAL = ["port", "cdp", "devtools", "token", "loopback", "browser", "gateway", "worker"]
_STATE = ["restricted", "indirectly", "through cli", "supports", "managed through", "latest", "current"]
# End of fixed values.
_or = lambda t, ws: "(" + " OR ".join(f"contains({t}, '{w}')" for w in ws) + ")"
_SPEC = lambda t: f"(CASE WHEN regexp_matches(lower({t}), '\\b\\d+\\b') THEN 0.2 ELSE 0.0 END + CASE WHEN {_or(f'lower({t})', _TECHNICAL)} THEN 0.2 ELSE 0.0 END + CASE WHEN {_or(f'lower({t})', _STATE)} THEN 0.2 ELSE 0.0 END + least(length({t}) / 300.0, 0.4))"


@R("SCO29_reconciled_bullets", f"""
WITH q AS (SELECT id, text FROM {{CUR}} WHERE text IS NOT NULL AND status = 'candidate' AND CAST('0x' || substr(md5(id), 1, 6) AS BIGINT) % 50 = 0), c AS (SELECT id, text FROM {{CUR}} WHERE text IS NOT NULL AND status = 'active'),
a AS {_vec_sql('q', 'id', 'text')}, b AS {_vec_sql('c', 'id', 'text')}, na AS (SELECT k, sqrt(sum(x * x)) AS n FROM a GROUP BY k), nb AS (SELECT k, sqrt(sum(x * x)) AS n FROM b GROUP BY k),
d AS (SELECT a.k AS id, b.k AS other, sum(a.x * b.x) AS dot FROM a JOIN b USING (p) GROUP BY ALL), r AS (SELECT d.id, other, round(dot / (na.n * nb.n), 6) AS similarity FROM d JOIN na ON d.id = na.k JOIN nb ON d.other = nb.k WHERE na.n > 0 AND nb.n > 0),
m AS (SELECT r.id, other, similarity, {_SPEC('q.text')} AS new_spec, {_SPEC('c.text')} AS old_spec FROM r JOIN q ON r.id = q.id JOIN c ON r.other = c.id WHERE similarity >= 0 QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY similarity DESC, other) = 1)
SELECT id, other, similarity, CASE WHEN similarity >= 0.92 THEN 'duplicate' WHEN similarity >= 0.75 THEN CASE WHEN new_spec > old_spec + 0.15 THEN 'evolve_replace' WHEN old_spec > new_spec + 0.15 THEN 'duplicate' ELSE 'evolve_append' END ELSE 'new' END AS verdict FROM m""")
def _(s, d):
    """Every 50th candidate (by its hash) against all active claims: duplicate, evolves the nearest one, or new."""
    c = claims(s, d, "text", "status").where("text IS NOT NULL")
    asked = c.where("status = 'candidate'").where((F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("long") % 50) == 0)
    active = c.where("status = 'active'")
    near = nearest_texts(asked, active, 1, 0.0)
    spec = lambda df, key, name: df.select(F.col("id").alias(key), _specificity(F.col("text")).alias(name))
    m = near.withColumnRenamed("chunk_id", "other").join(spec(asked, "id", "new_spec"), "id").join(spec(active, "other", "old_spec"), "other")
    evolves = F.when(F.col("new_spec") > F.col("old_spec") + 0.15, "evolve_replace").when(F.col("old_spec") > F.col("new_spec") + 0.15, "duplicate").otherwise("evolve_append")
    return m.select("id", "other", "similarity", F.when(F.col("similarity") >= 0.92, "duplicate").when(F.col("similarity") >= 0.75, evolves).otherwise("new").alias("verdict"))


@R("WIN14_timeline_views", """
WITH e AS (SELECT doc_id, strftime(captured_at, '%Y-%m-%d') AS day, '- ' || coalesce(kind, '') || ' ' || substr(replace(text, chr(10), ' '), 1, 60) AS bullet, captured_at FROM documents WHERE text IS NOT NULL AND captured_at IS NOT NULL)
SELECT 'day' AS view, day, bullet FROM (SELECT DISTINCT day, bullet FROM e) UNION ALL SELECT 'latest', day, bullet FROM (SELECT * FROM e ORDER BY captured_at DESC, doc_id DESC LIMIT 20)""")
def _(s, d):
    """Per day each bullet once, and the last 20 events."""
    t = table(s, d, "documents").where("text IS NOT NULL AND captured_at IS NOT NULL")
    bullet = F.concat(F.lit("- "), F.coalesce("kind", F.lit("")), F.lit(" "), F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, 60))
    e = t.select("doc_id", F.date_format("captured_at", "yyyy-MM-dd").alias("day"), bullet.alias("bullet"), "captured_at")
    latest = e.orderBy(F.desc("captured_at"), F.desc("doc_id")).limit(20)
    return e.select(F.lit("day").alias("view"), "day", "bullet").distinct().unionByName(latest.select(F.lit("latest").alias("view"), "day", "bullet"))


@R("RPT15_pages_by_key", "SELECT id, updated_at, 1 AS page FROM (SELECT id, updated_at FROM {CUR} WHERE status = 'active' ORDER BY id LIMIT 100) UNION ALL SELECT id, updated_at, 2 FROM (SELECT id, updated_at FROM {CUR} WHERE status = 'active' ORDER BY id LIMIT 100 OFFSET 100)")
def _(s, d):
    """Two pages of 100 by keyset: the second begins after the last id of the first, no offset is counted."""
    c = claims(s, d, "status", "updated_at").where("status = 'active'").select("id", "updated_at")
    out, after = None, None
    for page in (1, 2):
        rows = (c if after is None else c.where(F.col("id") > after)).orderBy("id").limit(100)
        last = rows.agg(F.max("id")).first()[0]
        part = rows.withColumn("page", F.lit(page))
        out = part if out is None else out.unionByName(part)
        if last is None:
            break
        after = last
    return out


@R("RPT17_marked_feedback", "SELECT q.item_id, CASE WHEN q.item_id % 2 = 0 THEN 'useful' ELSE 'bad' END AS verdict, kind AS query_type FROM eval_items q JOIN (" + _TEXT_SQL["FUN09_query_types"] + ") USING (item_id)")
def _(s, d):
    """Feedback rows of questions (here the even ones useful), with the query type that the question's words give."""
    kinds = _TEXT["FUN09_query_types"](s, d)
    return kinds.select("item_id", F.when(F.col("item_id") % 2 == 0, "useful").otherwise("bad").alias("verdict"), F.col("kind").alias("query_type"))


_BUCKET = "CASE WHEN contains(p, 'memory') THEN 'memory_system' WHEN regexp_matches(p, 'browser|cdp|devtools|vnc') THEN 'browser' WHEN regexp_matches(p, 'worker|upload|couchdb') THEN 'worker' WHEN regexp_matches(p, 'gateway|proxy') THEN 'gateway' WHEN p LIKE '%.md' OR regexp_matches(p, 'boot|identity|tools|user') THEN 'docs' WHEN regexp_matches(p, 'project-state|knowledge_base|project') THEN 'project_state' ELSE 'other' END"


@R("RPT23_seven_buckets", f"SELECT {_BUCKET} AS bucket, string_split(p, '/')[2] AS top, count(*) AS n FROM (SELECT DISTINCT lower(file_path) AS p FROM code_chunks WHERE file_path IS NOT NULL) GROUP BY ALL")
def _(s, d):
    p = F.col("p")
    bucket = F.when(F.contains(p, F.lit("memory")), "memory_system").when(p.rlike("browser|cdp|devtools|vnc"), "browser").when(p.rlike("worker|upload|couchdb"), "worker").when(p.rlike("gateway|proxy"), "gateway").when(p.endswith(".md") | p.rlike("boot|identity|tools|user"), "docs").when(p.rlike("project-state|knowledge_base|project"), "project_state").otherwise("other")
    files_ = table(s, d, "code_chunks").where("file_path IS NOT NULL").select(F.lower("file_path").alias("p")).distinct()
    return files_.groupBy(bucket.alias("bucket"), F.get(F.split("p", "/"), F.lit(1)).alias("top")).agg(F.count(F.lit(1)).alias("n"))


_PORCELAIN = "(SELECT DISTINCT CASE length(file_path) % 5 WHEN 0 THEN '?? ' WHEN 1 THEN ' M ' WHEN 2 THEN 'A  ' WHEN 3 THEN 'AM ' ELSE 'R  ' END || file_path AS line FROM code_chunks WHERE file_path IS NOT NULL)"


@R("RPT24_status_lists", f"""
SELECT 'untracked_files' AS list, trim(substr(line, 4), ' ') AS path FROM {_PORCELAIN} WHERE starts_with(line, '?? ')
UNION ALL SELECT list, trim(substr(line, 4), ' ') FROM (SELECT line, unnest(list_filter(['tracked_changed', CASE WHEN contains(substr(line, 1, 2), 'A') THEN 'added_files' END, CASE WHEN contains(substr(line, 1, 2), 'D') THEN 'removed_files' END, CASE WHEN contains(substr(line, 1, 2), 'M') THEN 'modified_files' END, CASE WHEN contains(substr(line, 1, 2), 'R') THEN 'renamed_files' END], lambda x: x IS NOT NULL)) AS list FROM {_PORCELAIN} WHERE NOT starts_with(line, '?? '))""")
def _(s, d):
    """Lines of a short status as (list, path); a line can be in several lists. The lines are made from the chunks' paths."""
    n = F.length("file_path") % 5
    mark = F.when(n == 0, "?? ").when(n == 1, " M ").when(n == 2, "A  ").when(n == 3, "AM ").otherwise("R  ")
    lines = table(s, d, "code_chunks").where("file_path IS NOT NULL").select(F.concat(mark, "file_path").alias("line")).distinct()
    status = F.substring("line", 1, 2)
    has = lambda c, name: F.when(F.contains(status, F.lit(c)), name)
    lists = F.when(status == "??", F.array(F.lit("untracked_files"))).otherwise(F.array_compact(F.array(F.lit("tracked_changed"), has("A", "added_files"), has("D", "removed_files"), has("M", "modified_files"), has("R", "renamed_files"))))
    return lines.select(F.explode(lists).alias("list"), F.trim(F.expr("substring(line, 4)")).alias("path"))


_EVENTS = "(SELECT doc_id, source_agent, strftime(captured_at, '%Y-%m-%d') AS day_key, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE kind = 'transcript' AND text IS NOT NULL)"


@R("RPT29_visible_events", f"""
SELECT 'timeline-' || substr(sha1(concat_ws('|', CAST(doc_id AS VARCHAR), CAST(pos AS VARCHAR), role, said)), 1, 16) AS event_id, source_agent AS agent_name, day_key, role, said AS text FROM (
SELECT doc_id, source_agent, day_key, pos, CASE WHEN starts_with(line, 'USER: ') THEN 'user' WHEN starts_with(line, 'ASSISTANT: ') THEN 'assistant' END AS role, trim(regexp_replace(line, '^[A-Z]+: ', ''), ' ') AS said FROM {_EVENTS}) WHERE role IS NOT NULL AND said <> '' AND said <> 'HEARTBEAT_OK'""")
def _(s, d):
    """What users and assistants said, with ids by content: nothing else of a transcript, no heartbeats."""
    t = table(s, d, "documents").where("kind = 'transcript' AND text IS NOT NULL")
    lines = t.select("doc_id", F.col("source_agent").alias("agent_name"), F.date_format("captured_at", "yyyy-MM-dd").alias("day_key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    role = F.when(F.startswith("line", F.lit("USER: ")), "user").when(F.startswith("line", F.lit("ASSISTANT: ")), "assistant")
    said = lines.withColumns({"role": role, "text": F.trim(F.regexp_replace("line", "^[A-Z]+: ", ""))}).where("role IS NOT NULL AND text <> '' AND text <> 'HEARTBEAT_OK'")
    eid = F.concat(F.lit("timeline-"), F.substring(F.sha1(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("pos").cast("string"), "role", "text")), 1, 16))
    return said.select(eid.alias("event_id"), "agent_name", "day_key", "role", "text")


_SIG = "(SELECT source, max(epoch_us(captured_at)) // 1000 AS mtime, sum(n_chars) AS size FROM documents WHERE source IS NOT NULL AND {0} GROUP BY source)"


@R("RPT31_changed_sessions", f"""
SELECT n.source, n.mtime, n.size FROM {_SIG.format('TRUE')} n LEFT JOIN {_SIG.format('doc_id % 7 <> 0')} o ON n.source = o.source AND n.mtime IS NOT DISTINCT FROM o.mtime AND n.size IS NOT DISTINCT FROM o.size WHERE o.source IS NULL ORDER BY CASE WHEN n.source LIKE '%reset%' THEN 0 ELSE 1 END, n.mtime DESC NULLS LAST, n.source LIMIT 50""")
def _(s, d):
    """Sessions whose signature (time, size) isn't the recorded one: rotated ones first, then the newest; 50 a run."""
    t = table(s, d, "documents").where("source IS NOT NULL")
    sig = lambda df: df.groupBy("source").agg(F.max(F.unix_millis("captured_at")).alias("mtime"), F.sum("n_chars").alias("size"))
    now, before = sig(t), sig(t.where("doc_id % 7 <> 0")).select(F.col("source").alias("os"), F.col("mtime").alias("om"), F.col("size").alias("oz"))
    same = (F.col("source") == F.col("os")) & F.col("mtime").eqNullSafe(F.col("om")) & F.col("size").eqNullSafe(F.col("oz"))
    changed = now.join(before, same, "left_anti")
    return changed.orderBy(F.when(F.contains("source", F.lit("reset")), 0).otherwise(1), F.desc_nulls_last("mtime"), "source").limit(50)


_INSIGHTS = "(SELECT '- ' || replace(text, chr(10), ' ') || CASE WHEN project_id IS NULL THEN '' ELSE ' [source_project=' || project_id || ']' END AS line, status FROM {CUR} WHERE text IS NOT NULL)"


@R("RPT42_parsed_insights", f"""
WITH l AS (SELECT DISTINCT line FROM {_INSIGHTS} WHERE status <> 'active' AND line NOT IN (SELECT line FROM {_INSIGHTS} WHERE status = 'active'))
SELECT line, regexp_extract(substr(line, 3), '^(.*) \\[source_project=([^\\]]*)\\]$', 2) AS source_project, CASE WHEN regexp_matches(line, ' \\[source_project=[^\\]]*\\]$') THEN trim(regexp_replace(substr(line, 3), ' \\[source_project=[^\\]]*\\]$', ''), ' ') ELSE substr(line, 3) END AS text FROM l""")
def _(s, d):
    """Insight lines that aren't in the file yet (here: those of active claims), with the project suffix parsed back."""
    c = claims(s, d, "text", "project_id", "status").where("text IS NOT NULL")
    line = F.concat(F.lit("- "), F.replace("text", F.lit("\n"), F.lit(" ")), F.coalesce(F.concat(F.lit(" [source_project="), "project_id", F.lit("]")), F.lit("")))
    lines = c.select(line.alias("line"), "status")
    fresh = store.append_new(lines.where("status = 'active'").select("line"), lines.where("status <> 'active'").select("line"), "line")
    suffix = r" \[source_project=[^\]]*\]$"
    body = F.expr("substring(line, 3)")
    return fresh.select("line", F.regexp_extract(body, r"^(.*) \[source_project=([^\]]*)\]$", 2).alias("source_project"), F.when(F.col("line").rlike(suffix), F.trim(F.regexp_replace(body, suffix, ""))).otherwise(body).alias("text"))


@R("FUN02_since", "SELECT 'today' AS since, count(*) FILTER (updated_at >= TIMESTAMPTZ '2026-09-01 00:00:00+00') AS n FROM {CUR} UNION ALL SELECT 'yesterday', count(*) FILTER (updated_at >= TIMESTAMPTZ '2026-08-31 00:00:00+00') FROM {CUR} UNION ALL SELECT 'week', count(*) FILTER (updated_at >= TIMESTAMPTZ '2026-08-25 00:00:00+00') FROM {CUR} UNION ALL SELECT '36h', count(*) FILTER (updated_at >= TIMESTAMPTZ '2026-08-30 12:00:00+00') FROM {CUR} UNION ALL SELECT '90d', count(*) FILTER (updated_at >= TIMESTAMPTZ '2026-06-03 00:00:00+00') FROM {CUR} UNION ALL SELECT '52w', count(*) FILTER (updated_at >= TIMESTAMPTZ '2025-09-02 00:00:00+00') FROM {CUR} UNION ALL SELECT '2025-06-01', count(*) FILTER (updated_at >= TIMESTAMPTZ '2025-06-01 00:00:00+00') FROM {CUR}")
def _(s, d):
    """How many claims changed since each time expression, seen from AS_OF."""
    now = datetime.fromisoformat(AS_OF)
    asked = ["today", "yesterday", "week", "36h", "90d", "52w", "2025-06-01"]
    hits = [F.struct(F.lit(a).alias("since"), F.count_if(F.col("updated_at") >= F.lit(dates.parse_since(a, now).isoformat(sep=" ")).cast("timestamp")).alias("n")) for a in asked]
    return claims(s, d, "updated_at").agg(F.array(*hits).alias("x")).select(F.explode("x").alias("x")).select("x.*")


@R("FUN03_time_references", "SELECT * FROM (VALUES ('what changed on 2025-06-03', TIMESTAMP '2025-06-03', TIMESTAMP '2025-06-04'), ('3 days ago', TIMESTAMP '2026-08-28', TIMESTAMP '2026-08-30'), ('last 2 weeks', TIMESTAMP '2026-08-18', TIMESTAMP '2026-09-01'), ('in march 2025', TIMESTAMP '2025-03-01', TIMESTAMP '2025-04-01'), ('december', TIMESTAMP '2025-12-01', TIMESTAMP '2026-01-01'), ('pipeline owner', NULL, NULL)) AS t(question, lo, hi)")
def _(s, d):
    now = datetime.fromisoformat(AS_OF)
    rows = [(q, *(dates.time_reference(q, now) or (None, None))) for q in ("what changed on 2025-06-03", "3 days ago", "last 2 weeks", "in march 2025", "december", "pipeline owner")]
    return s.createDataFrame(rows, "question string, lo timestamp_ntz, hi timestamp_ntz")


def _written_events(s, d) -> str:
    """Events as JSON lines with blank and broken lines between them, in the shared folder."""
    path = scratch(s, "json-lines")
    e = table(s, d, "events").select("event_id", "event_type", "value")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    e.select(F.when(F.col("event_id") % 10 == 0, F.concat(line, F.lit("\n\n{broken"))).otherwise(line).alias("value")).write.text(path)
    return path


@R("SRC07_json_lines", "SELECT event_id, event_type, value FROM events")
def _(s, d):
    return files.json_lines(s, _written_events(s, d), "event_id long, event_type string, value double").where("event_id IS NOT NULL")


@R("SRC08_json_in_text", "SELECT id, text FROM {CUR} WHERE text IS NOT NULL AND coalesce(entity, '') <> ''")
def _(s, d):
    """JSON lines inside a text column: NONE stands for no row."""
    c = claims(s, d, "text", "entity").where("text IS NOT NULL")
    held = c.select(F.when(F.coalesce("entity", F.lit("")) != "", F.concat(F.to_json(F.struct("id", "text")), F.lit("\nNONE\n{broken"))).otherwise("NONE").alias("out"))
    return files.embedded_json(held, "out", "id string, text string").where("id IS NOT NULL")


def _written_sessions(s, d, suffix: str) -> str:
    path = scratch(s, "sessions")
    t = table(s, d, "documents").where("text IS NOT NULL AND source_agent IS NOT NULL").select(F.concat(F.lit("- "), F.replace("text", F.lit("\n"), F.lit(" "))).alias("value"), F.col("source_agent").alias("agent"))
    t.write.partitionBy("agent").text(path)
    return path


@R("SRC09_newest_session_of_agent", "SELECT DISTINCT source_agent AS agent FROM documents WHERE text IS NOT NULL AND source_agent IS NOT NULL")
def _(s, d):
    """The newest file of each agent's folder; which one that is depends on the clock, that there is one for each doesn't."""
    snap = files.directory_snapshot(s, _written_sessions(s, d, "txt"))
    newest = files.newest_file(snap, F.regexp_extract("path", "agent=([^/]+)/", 1))
    return newest.where("path IS NOT NULL").select(F.url_decode("group").alias("agent"))


@R("SRC10_pending_sessions", "SELECT DISTINCT source_agent AS agent FROM documents WHERE text IS NOT NULL AND source_agent IS NOT NULL AND source_agent <> 'scout'")
def _(s, d):
    """Files that no checkpoint has recorded: here all of agents but scout's."""
    snap = files.directory_snapshot(s, _written_sessions(s, d, "txt"))
    done = snap.where(F.contains("path", F.lit("agent=scout/"))).select("path", "sha1")
    return snap.join(done, ["path", "sha1"], "left_anti").select(F.url_decode(F.regexp_extract("path", "agent=([^/]+)/", 1)).alias("agent")).distinct()


@R("SRC12_directory_snapshot", "SELECT source_agent AS agent, sum(length(encode('- ' || replace(text, chr(10), ' '))) + 1) AS bytes FROM documents WHERE text IS NOT NULL AND source_agent IS NOT NULL AND source_agent <> 'coder' GROUP BY source_agent".replace("length(encode(", "octet_length(encode("))
def _(s, d):
    """Bytes of each agent's files in a snapshot, without ignored paths."""
    snap = files.directory_snapshot(s, _written_sessions(s, d, "txt")).where(~F.contains("path", F.lit("agent=coder/")))
    return snap.groupBy(F.url_decode(F.regexp_extract("path", "agent=([^/]+)/", 1)).alias("agent")).agg(F.sum("size").alias("bytes"))


@R("STR03_dead_letters", "SELECT event_id FROM events WHERE event_type IS NULL OR event_type NOT IN ('signup', 'error', 'click', 'view', 'purchase') OR NOT coalesce(json_valid(props), FALSE)")
def _(s, d):
    return _drain(s, d, lambda e: ev.dead_letters(e).select("event_id"))


@R("STR07_debounced")
def _(s, d):
    """Bursts of each user's events, ended by half a day of quiet or two days in all; run as a stream, tested against a walk."""
    return _drain(s, d, lambda e: ev.debounced(e, "user_id", "at", 43_200, 172_800))


_QUEUE = "(SELECT event_id, CASE WHEN event_type IN ('error', 'purchase') THEN event_type || '-' || user_id END AS k, CASE WHEN value < 20 THEN 'pending' WHEN value < 40 THEN 'processing' ELSE 'done' END AS status FROM events WHERE {0})"


@R("STR08_enqueued", f"""
WITH q AS {_QUEUE.format('event_id % 2 = 0')}, r AS {_QUEUE.format('event_id % 2 = 1')}, o AS (SELECT k, max(event_id) AS there FROM q WHERE status <> 'done' AND k IS NOT NULL GROUP BY k), f AS (SELECT k, min(event_id) AS first FROM r WHERE k IS NOT NULL GROUP BY k)
SELECT r.event_id AS request_id, coalesce(there, first, r.event_id) AS trigger_id, there IS NULL AND coalesce(first, r.event_id) = r.event_id AS fresh FROM r LEFT JOIN o ON r.k = o.k LEFT JOIN f ON r.k = f.k""")
def _(s, d):
    e = table(s, d, "events")
    rows = e.select("event_id", F.when(F.col("event_type").isin("error", "purchase"), F.concat_ws("-", "event_type", F.col("user_id").cast("string"))).alias("dedupe_key"), F.when(F.col("value") < 20, "pending").when(F.col("value") < 40, "processing").otherwise("done").alias("status"))
    q = rows.where("event_id % 2 = 0").withColumnRenamed("event_id", "trigger_id")
    return queue.enqueue(q, rows.where("event_id % 2 = 1").select(F.col("event_id").alias("request_id"), "dedupe_key"))


@R("STR09_stale_failed", """
SELECT event_id, CASE WHEN s THEN 'failed' ELSE status END AS status, CASE WHEN s THEN coalesce(error_text, '') || CASE WHEN coalesce(error_text, '') = '' THEN '' ELSE chr(10) END || 'janitor_marked_stale_after_300s' ELSE error_text END AS error_text FROM (
SELECT *, status = 'processing' AND ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 300 SECOND AS s FROM (SELECT event_id, ts, CASE WHEN event_type = 'view' THEN 'processing' ELSE 'done' END AS status, CASE WHEN event_id % 3 = 0 THEN 'slow' END AS error_text FROM events))""")
def _(s, d):
    e = table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("started_at"), F.when(F.col("event_type") == "view", "processing").otherwise("done").alias("status"), F.when(F.col("event_id") % 3 == 0, "slow").alias("error_text"), F.lit(None).cast("timestamp").alias("finished_at"))
    return queue.fail_stale(e, F.lit("2024-01-20 00:00:00").cast("timestamp"), 300).select("event_id", "status", "error_text")


@R("STR10_checkpoint_states", """
SELECT b.user_id AS checkpoint_id, coalesce(max_by(CASE u.event_type WHEN 'purchase' THEN 'committed' ELSE 'failed' END, (u.ts, CASE u.event_type WHEN 'purchase' THEN 'committed' ELSE 'failed' END)), 'processing') AS status, max(u.ts) AS finished_at
FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') b LEFT JOIN (SELECT * FROM events WHERE event_type IN ('purchase', 'error')) u ON b.user_id = u.user_id GROUP BY b.user_id""")
def _(s, d):
    """Checkpoints begun by a signup and ended by a purchase (committed) or an error (failed)."""
    e = table(s, d, "events")
    begun = e.where("event_type = 'signup'").select(F.col("user_id").alias("checkpoint_id")).distinct()
    updates = e.where("event_type IN ('purchase', 'error')").select(F.col("user_id").alias("checkpoint_id"), F.when(F.col("event_type") == "purchase", "committed").otherwise("failed").alias("status"), F.col("ts").alias("at"))
    return queue.checkpoints(begun, updates)


@R("STR15_synced_by_mark", "SELECT id, CASE WHEN updated_at <= TIMESTAMPTZ '2026-01-01 00:00:00+00' THEN 1 ELSE 2 END AS run FROM {CUR} WHERE status = 'active' AND updated_at IS NOT NULL")
def _(s, d):
    """Two sync runs of active claims: what was there by 2026, and what came after the stored mark."""
    mark, out = scratch(s, "mark"), scratch(s, "synced")
    c = claims(s, d, "status", "updated_at").where("status = 'active'").select("id", "updated_at")
    for run, rows in ((1, c.where("updated_at <= TIMESTAMP '2026-01-01 00:00:00'")), (2, c)):
        queue.sync_since(rows, "updated_at", mark, lambda df, run=run: df.select("id", F.lit(run).alias("run")).write.mode("append").parquet(out))
    return s.read.schema("id string, run int").parquet(out)


@R("RPT44_cleared_flags", "SELECT id, CASE WHEN status = 'active' AND lower(suggested_route) = 'auto' THEN NULL ELSE suggested_route END AS suggested_route, coalesce(status = 'active' AND lower(suggested_route) = 'auto', FALSE) AS worked FROM {CUR}")
def _(s, d):
    """The store after its AUTO work list was processed: the flag of those rows is cleared."""
    todo = F.coalesce((F.col("status") == "active") & (F.lower("suggested_route") == "auto"), F.lit(False))
    return claims(s, d, "status", "suggested_route").withColumn("worked", todo).select("id", F.when(~F.col("worked"), F.col("suggested_route")).alias("suggested_route"), "worked")
