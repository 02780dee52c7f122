"""Whole forms of scans, store changes, roll-ups, orders and metrics (SRC, FLT, SNK, AGG, WIN, TOP, EVA, GRA, RPT)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamspark.operators import graph, store, temporal
from loamspark.plans.aggregate_queries import QUERIES as _AGG
from loamspark.plans.aggregate_queries import SQL as _AGG_SQL
from loamspark.plans.common import Registry, as_of, claims
from loamspark.plans.store_queries import QUERIES as _STORE
from loamspark.plans.store_queries import SQL as _STORE_SQL
from loamspark.session import scratch, table

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL

#: The columns of a canonical item, in order.
ITEM = "id text memory_type scope entity property value status confidence importance freshness_class source_agent source_session source_chunk first_seen last_confirmed supersedes tags notes candidate_id candidate_score candidate_reasons suggested_route target_file target_section sensitivity approved_at approved_by approval_source rejected_at rejected_by rejection_reason rejection_source ranking_bonus ranking_penalty feedback_last_applied_at".split()
_ITEMS_SQL = f"SELECT {', '.join(ITEM)} FROM {{CUR}} WHERE status = 'active' ORDER BY id"


def canonical_items(s, d, status: str):
    """All 36 columns of the current rows of a status, ordered by id (a range-partitioned sort)."""
    return claims(s, d, *[c for c in ITEM if c != "id"]).where(F.col("status") == status).select(*ITEM).orderBy("id")


@R("SRC01_canonical_items", _ITEMS_SQL)
def _(s, d):
    return canonical_items(s, d, "active")


@R("SRC02_items_by_status", _ITEMS_SQL)
def _(s, d):
    """The older name of SRC01."""
    return canonical_items(s, d, "active")


#: The row-wise form of the metadata filter is the same column expression, and so can't differ from it.
QUERIES["FLT02_row_filter"], SQL["FLT02_row_filter"] = _STORE["FLT01_metadata_filter"], _STORE_SQL["FLT01_metadata_filter"]
QUERIES["RPT04_low_utility_listing"], SQL["RPT04_low_utility_listing"] = _AGG["AGG03_low_utility"], _AGG_SQL["AGG03_low_utility"]


@R("WIN02_slot_sizes", "SELECT id, count(*) OVER (PARTITION BY entity, property) AS n FROM {CUR} WHERE entity IS NOT NULL AND property IS NOT NULL")
def _(s, d):
    """The number of rows in each row's slot, by a count that is joined back: a hot slot is counted map-side."""
    c = claims(s, d, "entity", "property").where("entity IS NOT NULL AND property IS NOT NULL")
    return c.join(c.groupBy("entity", "property").agg(F.count(F.lit(1)).alias("n")), ["entity", "property"]).select("id", "n")


_RANKED = "(SELECT id AS item, entity AS query, CASE memory_type WHEN 'decision' THEN 1 ELSE 0 END AS rel, row_number() OVER (PARTITION BY entity ORDER BY last_confirmed DESC NULLS LAST, id) AS rank FROM {CUR} WHERE entity IS NOT NULL AND entity <> 'general')"


def _ranked(s, d, k: int):
    """(query, item, rel, rank) of the first k claims of each entity, newest first; and what is relevant in all of it."""
    c = claims(s, d, "entity", "memory_type", "last_confirmed").where("entity IS NOT NULL AND entity <> 'general'")
    c = c.select(F.col("id").alias("item"), F.col("entity").alias("query"), (F.col("memory_type") == "decision").cast("int").alias("rel"), "last_confirmed")
    c = c.withColumn("rel", F.coalesce("rel", F.lit(0)))
    w = Window.partitionBy("query").orderBy(F.desc_nulls_last("last_confirmed"), "item")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), c.groupBy("query").agg(F.sum("rel").alias("wanted"))


@R("WIN13_discounted_gains", f"SELECT query, item, round(rel / log2(rank + 1.0), 6) AS gain FROM {_RANKED} WHERE rank <= 10")
def _(s, d):
    return _ranked(s, d, 10)[0].select("query", "item", F.round(F.col("rel") / F.log2(F.col("rank") + 1.0), 6).alias("gain"))


@R("EVA01_both_variants", f"""
WITH r AS {_RANKED}, t AS (SELECT query, sum(rel) AS hits, count(*) AS got, min(CASE WHEN rel = 1 THEN rank END) AS first FROM r WHERE rank <= 10 GROUP BY query), w AS (SELECT query, sum(rel) AS wanted FROM r GROUP BY query)
SELECT query, round(CASE WHEN wanted = 0 THEN 0.0 ELSE hits / wanted END, 6) AS recall_zero, round(CASE WHEN wanted = 0 THEN 1.0 ELSE hits / wanted END, 6) AS recall_one, round(hits / 10.0, 6) AS precision_k, round(hits / got, 6) AS precision_got, round(coalesce(1.0 / first, 0), 6) AS mrr FROM t JOIN w USING (query)""")
def _(s, d):
    """Both published variants: nothing relevant scores 0 or 1, and precision divides by k or by what was retrieved."""
    top, wanted = _ranked(s, d, 10)
    t = top.groupBy("query").agg(F.sum("rel").alias("hits"), F.count(F.lit(1)).alias("got"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first")).join(wanted, "query")
    share = F.try_divide("hits", "wanted")
    six = lambda c, n: F.round(c, 6).alias(n)
    return t.select("query", six(F.coalesce(share, F.lit(0.0)), "recall_zero"), six(F.coalesce(share, F.lit(1.0)), "recall_one"), six(F.col("hits") / 10.0, "precision_k"), six(F.col("hits") / F.col("got"), "precision_got"), six(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), "mrr"))


@R("EVA10_recall_at_many_k", f"WITH r AS {_RANKED}, w AS (SELECT query, sum(rel) AS wanted FROM r GROUP BY query HAVING sum(rel) > 0) SELECT k, round(avg(coalesce(hits, 0) / wanted), 6) AS recall FROM (SELECT k, query, wanted, (SELECT sum(rel) FROM r WHERE r.query = w.query AND rank <= k) AS hits FROM w, (SELECT unnest([1, 3, 5, 8, 10, 20]) AS k)) GROUP BY k")
def _(s, d):
    """Mean recall at 1, 3, 5, 8, 10 and 20 over the queries with anything relevant; one ranking serves all k."""
    top, wanted = _ranked(s, d, 20)
    hits = top.groupBy("query").agg(*[F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias(f"k{k}") for k in (1, 3, 5, 8, 10, 20)])
    both = hits.join(wanted.where("wanted > 0"), "query")
    row = both.agg(*[F.round(F.avg(F.col(f"k{k}") / F.col("wanted")), 6).alias(f"k{k}") for k in (1, 3, 5, 8, 10, 20)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("recall")) for k in (1, 3, 5, 8, 10, 20)])).alias("x")).select("x.*").where("recall IS NOT NULL")


_MODES = {"recent": "created_at DESC NULLS LAST, id", "canonical": "coalesce(confidence, 0) DESC, id", "timeline": "created_at NULLS FIRST, id"}


@R("TOP12_four_modes", " UNION ALL ".join([f"SELECT '{m}' AS mode, * FROM (SELECT id, row_number() OVER (ORDER BY {o}) AS place FROM {{CUR}} WHERE status = 'active' QUALIFY place <= 25)" for m, o in _MODES.items()] + ["SELECT 'strict' AS mode, * FROM (SELECT id, row_number() OVER (ORDER BY confidence DESC, id) AS place FROM {CUR} WHERE status = 'active' AND confidence >= 0.8 QUALIFY place <= 25)"]))
def _(s, d):
    """The first 25 in each order: newest, most confident, oldest, and most confident of at least .8."""
    c = claims(s, d, "status", "created_at", "confidence").where("status = 'active'")
    sure = F.coalesce("confidence", F.lit(0.0)).desc()
    orders = {"recent": (c, [F.desc_nulls_last("created_at")]), "canonical": (c, [sure]), "timeline": (c, [F.asc_nulls_first("created_at")]), "strict": (c.where("confidence >= 0.8"), [sure])}
    out = None
    for mode, (rows, order) in orders.items():
        top = rows.orderBy(*order, "id").limit(25)
        part = top.select("id", F.row_number().over(Window.orderBy(*order, "id")).alias("place")).withColumn("mode", F.lit(mode))  # 25 rows
        out = part if out is None else out.unionByName(part)
    return out.select("mode", "id", "place")


@R("JON31_parity_of_both_stores", """
WITH c AS (SELECT id FROM {CUR}), q AS (SELECT DISTINCT coalesce(payload->>'$.id', payload->>'$.memory_id') AS id FROM qdrant_points WHERE coalesce(payload->>'$.id', payload->>'$.memory_id') IS NOT NULL), n AS (SELECT DISTINCT id FROM neo4j_nodes WHERE id IS NOT NULL)
SELECT kind, id FROM (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY id) AS r FROM (
SELECT 'missing_in_vector' AS kind, id FROM c WHERE id NOT IN (SELECT id FROM q) UNION ALL SELECT 'orphan_in_vector', id FROM q WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT 'missing_in_graph', id FROM c WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT 'orphan_in_graph', id FROM n WHERE id NOT IN (SELECT id FROM c))) WHERE r <= 500""")
def _(s, d):
    """Ids that a store lacks or has alone, the first 500 of each kind, which is the report's length."""
    c = claims(s, d, "status").select("id")
    p = table(s, d, "qdrant_points").select(F.try_parse_json("payload").alias("p"))
    q = p.select(F.coalesce(F.try_variant_get("p", "$.id", "string"), F.try_variant_get("p", "$.memory_id", "string")).alias("id")).where("id IS NOT NULL").distinct()
    n = table(s, d, "neo4j_nodes").where("id IS NOT NULL").select("id").distinct()
    parts = {"missing_in_vector": (c, q), "orphan_in_vector": (q, c), "missing_in_graph": (c, n), "orphan_in_graph": (n, c)}
    out = None
    for kind, (a, b) in parts.items():
        part = a.join(b, "id", "left_anti").orderBy("id").limit(500).select(F.lit(kind).alias("kind"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@R("WIN04_superseded_by_newest", """
WITH c AS (SELECT id, lower(trim(entity, ' ')) AS e, lower(trim(property, ' ')) AS p, source_agent, status, coalesce(last_confirmed, first_seen) AS t FROM {CUR} WHERE trim(coalesce(entity, ''), ' ') <> '' AND trim(coalesce(property, ''), ' ') <> ''),
n AS (SELECT e, p, coalesce(source_agent, '') AS a, id AS newest FROM c WHERE status = 'candidate' QUALIFY row_number() OVER (PARTITION BY e, p ORDER BY t DESC NULLS LAST, id) = 1)
SELECT c.id, n.newest FROM c JOIN n ON c.e = n.e AND c.p = n.p AND c.source_agent = n.a WHERE c.status = 'active' AND c.id <> n.newest""")
def _(s, d):
    """Active claims that the newest of a batch (here the candidates) in their slot supersedes, of the same agent; and by which."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    c = claims(s, d, "entity", "property", "source_agent", "status", "last_confirmed", "first_seen").where(blank("entity") & blank("property"))
    c = c.select("id", F.lower(F.trim("entity")).alias("e"), F.lower(F.trim("property")).alias("p"), "source_agent", "status", F.coalesce("last_confirmed", "first_seen").alias("t"))
    # the newest by (t, smaller id) as a map-side maximum: no slot is ordered
    rank = F.struct(F.col("t").isNotNull(), F.col("t"))
    best = c.where("status = 'candidate'").groupBy("e", "p").agg(F.max(rank).alias("m"))
    newest = c.where("status = 'candidate'").withColumn("m", rank).join(best.withColumnRenamed("m", "b"), ["e", "p"]).where(F.col("m").eqNullSafe(F.col("b"))).groupBy("e", "p").agg(F.min(F.struct("id", F.coalesce("source_agent", F.lit("")).alias("a"))).alias("n"))
    newest = newest.select("e", "p", F.col("n.a").alias("source_agent"), F.col("n.id").alias("newest"))
    return c.where("status = 'active'").join(newest, ["e", "p", "source_agent"]).where("id <> newest").select("id", "newest")


_SAID = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE kind = 'transcript' AND text IS NOT NULL)"


@R("WIN08_pairs_by_user_turns", f"""
WITH t AS (SELECT doc_id, pos, starts_with(line, 'USER: ') AS u FROM {_SAID} WHERE starts_with(line, 'USER: ') OR starts_with(line, 'ASSISTANT: ')), g AS (SELECT doc_id, u, coalesce(sum(CAST(u AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 2 AS grp FROM t)
SELECT doc_id, grp, count(*) AS turns, sum(CAST(u AS INT)) AS users FROM g GROUP BY ALL""")
def _(s, d):
    """Turns of a transcript in groups that close with every second user turn. The window runs over one text's lines."""
    t = table(s, d, "documents").where("kind = 'transcript' AND text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    t = t.withColumn("u", F.startswith("line", F.lit("USER: ")).cast("int")).where(F.col("line").rlike("^(USER|ASSISTANT): "))
    before = F.coalesce(F.sum("u").over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.withColumn("grp", F.floor(before / 2)).groupBy("doc_id", "grp").agg(F.count(F.lit(1)).alias("turns"), F.sum("u").alias("users"))


@R("AGG25_full_hierarchy", """
WITH c AS (SELECT id, coalesce(source_session, 'none') AS session, memory_type, confidence, date_trunc('day', coalesce(first_seen, created_at)) AS day, date_trunc('week', coalesce(first_seen, created_at)) AS week, epoch_us(coalesce(first_seen, created_at)) AS us, CAST(supersedes IS NOT NULL AS INT) AS against FROM {CUR} WHERE coalesce(first_seen, created_at) IS NOT NULL)
SELECT CASE GROUPING(week, day, session) WHEN 0 THEN 'event' WHEN 1 THEN 'day' WHEN 3 THEN 'week' ELSE 'root' END AS level, strftime(week, '%Y-%m-%d') AS week, strftime(day, '%Y-%m-%d') AS day, session, count(*) AS n, round(avg(CASE WHEN confidence > 0 THEN confidence END), 6) AS avg_confidence, sum(against) AS contradictions,
 count(*) FILTER (memory_type = 'decision') AS decisions, count(*) FILTER (memory_type = 'fact') AS facts, count(*) FILTER (memory_type NOT IN ('decision', 'fact') OR memory_type IS NULL) AS others, min(us) AS first_us, max(us) AS last_us FROM c GROUP BY ROLLUP (week, day, session)""")
def _(s, d):
    """Sessions, days, weeks (from Monday) and all, by one rollup: counts, confidence (non-zero only), contradictions, kinds, range."""
    at = F.coalesce("first_seen", "created_at")
    c = claims(s, d, "source_session", "memory_type", "confidence", "first_seen", "created_at", "supersedes").where(at.isNotNull())
    day = lambda unit: F.date_format(F.date_trunc(unit, at), "yyyy-MM-dd")
    c = c.select(day("WEEK").alias("week"), day("DAY").alias("day"), F.coalesce("source_session", F.lit("none")).alias("session"), "memory_type", "confidence", F.unix_micros(at).alias("us"), F.col("supersedes").isNotNull().cast("int").alias("against"))
    kind = lambda *ks: F.count_if(F.coalesce(F.col("memory_type"), F.lit("")).isin(*ks))
    g = c.rollup("week", "day", "session").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), 6).alias("avg_confidence"), F.sum("against").alias("contradictions"), kind("decision").alias("decisions"), kind("fact").alias("facts"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    level = F.when(F.col("g") == 0, "event").when(F.col("g") == 1, "day").when(F.col("g") == 3, "week").otherwise("root")
    return g.select(level.alias("level"), "week", "day", "session", "n", "avg_confidence", "contradictions", "decisions", "facts", (F.col("n") - F.col("decisions") - F.col("facts")).alias("others"), "first_us", "last_us")


@R("AGG27_summary_parts", """
WITH c AS (SELECT id, source_session, 0.7 * coalesce(confidence, 0) + 0.3 * least(length(text) / 500.0, 1) AS score, trim(text, ' ') AS t FROM {CUR} WHERE source_session IS NOT NULL AND text IS NOT NULL AND NOT starts_with(trim(text, ' '), '{') AND NOT starts_with(trim(text, ' '), '[')),
r AS (SELECT *, row_number() OVER (PARTITION BY source_session ORDER BY round(score, 9) DESC, id) AS place FROM c)
SELECT source_session, string_agg(CASE WHEN length(t) <= 200 THEN t ELSE regexp_replace(substr(t, 1, 200), ' [^ ]*$', '') || '...' END, ' | ' ORDER BY place) AS summary FROM r WHERE place <= 8 GROUP BY source_session""")
def _(s, d):
    """The summary of a session: its 8 best claims by .7 confidence + .3 length, cut at a word within 200 characters; JSON is skipped."""
    c = claims(s, d, "source_session", "confidence", "text").where("source_session IS NOT NULL AND text IS NOT NULL").withColumn("t", F.trim("text")).where(~F.col("t").rlike(r"^[\{\[]"))
    score = F.round(0.7 * F.coalesce("confidence", F.lit(0.0)) + 0.3 * F.least(F.length("text") / 500.0, F.lit(1.0)), 9)
    w = Window.partitionBy("source_session").orderBy(F.desc("score"), "id")
    best = c.withColumn("score", score).withColumn("place", F.row_number().over(w)).where("place <= 8")
    cut = F.when(F.length("t") <= 200, F.col("t")).otherwise(F.concat(F.regexp_replace(F.substring("t", 1, 200), " [^ ]*$", ""), F.lit("...")))
    parts = best.groupBy("source_session").agg(F.array_sort(F.collect_list(F.struct("place", cut.alias("x")))).alias("xs"))  # at most 8 each
    return parts.select("source_session", F.array_join(F.transform("xs", lambda x: x["x"]), " | ").alias("summary"))


@R("AGG38_strongest_links", """
WITH l AS (SELECT id AS src, supersedes AS dst, 'SUPERSEDES' AS rel, 0.95 AS confidence FROM {CUR} WHERE supersedes IS NOT NULL UNION ALL SELECT id, supersedes, 'SUPERSEDES', coalesce(confidence, 0) FROM {CUR} WHERE supersedes IS NOT NULL)
SELECT src, dst, rel, max(confidence) AS confidence FROM l GROUP BY ALL""")
def _(s, d):
    """Of links found by several detectors (here a fixed and the claim's own confidence) the most confident of each (src, dst, rel)."""
    c = claims(s, d, "supersedes", "confidence").where("supersedes IS NOT NULL")
    link = lambda conf: c.select(F.col("id").alias("src"), F.col("supersedes").alias("dst"), F.lit("SUPERSEDES").alias("rel"), conf.alias("confidence"))
    return link(F.lit(0.95)).unionByName(link(F.coalesce("confidence", F.lit(0.0)))).groupBy("src", "dst", "rel").agg(F.max("confidence").alias("confidence"))


@R("SNK03_appended_feedback", "SELECT event_id, event_type, props AS raw FROM events")
def _(s, d):
    """Feedback rows with their raw payload, appended batch by batch to a table."""
    path = scratch(s, "feedback")
    e = table(s, d, "events").select("event_id", "event_type", F.col("props").alias("raw"))
    for part in range(3):
        e.where(F.pmod("event_id", F.lit(3)) == part).write.mode("append").parquet(path)
    return s.read.schema(e.schema).parquet(path)


@R("SNK05_upserted_embeddings", """
SELECT chunk_id, max(updated_at) AS updated_at FROM code_chunk_embeddings WHERE chunk_id IS NOT NULL GROUP BY chunk_id""")
def _(s, d):
    """Embeddings upserted by id in two batches, the later delivery of an id wins by its time."""
    e = table(s, d, "code_chunk_embeddings").where("chunk_id IS NOT NULL").select("chunk_id", "updated_at", F.hash("embedding").alias("h"))
    newest = lambda df: df.groupBy("chunk_id").agg(F.max(F.struct("updated_at", "h")).alias("b")).select("chunk_id", "b.updated_at", "b.h")
    odd = F.pmod(F.xxhash64("chunk_id", "updated_at"), F.lit(2)) == 1
    old, new = newest(e.where(~odd)), newest(e.where(odd))
    late = new.join(old.select("chunk_id", F.col("updated_at").alias("was")), "chunk_id", "left").where("was IS NULL OR updated_at > was").drop("was")
    return store.upsert(old, late, ["chunk_id"]).select("chunk_id", "updated_at")


@R("SNK18_restored_after_cleanup", "SELECT id, status FROM {CUR}")
def _(s, d):
    """A restore point is written, rows of a prefix are cleaned up, and the restore point brings them back."""
    c = claims(s, d, "status").select("id", "status")
    point = scratch(s, "restore-point")
    c.write.parquet(point)
    cleaned = c.where(~F.startswith("id", F.lit("mi_0")))
    kept = s.read.schema(c.schema).parquet(point)
    return cleaned.unionByName(kept.join(cleaned.select("id"), "id", "left_anti"))


@R("GRA03_typed_hops", """
WITH l AS (SELECT id AS src, supersedes AS dst FROM {CUR} WHERE supersedes IS NOT NULL), e AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l), s AS (SELECT DISTINCT src AS id FROM l ORDER BY src LIMIT 20),
h1 AS (SELECT DISTINCT s.id AS start, e.dst AS node FROM s JOIN e ON s.id = e.src), h2 AS (SELECT DISTINCT h1.start, e.dst AS node FROM h1 JOIN e ON h1.node = e.src WHERE e.dst <> h1.start AND (h1.start, e.dst) NOT IN (SELECT start, node FROM h1))
SELECT start, node, 2 AS hops FROM h2 ORDER BY start, node LIMIT 20""")
def _(s, d):
    """Nodes exactly two steps away from the first 20 superseding claims, over SUPERSEDES edges either way; 20 at most."""
    c = claims(s, d, "supersedes").where("supersedes IS NOT NULL")
    e = c.select(F.col("id").alias("src"), F.col("supersedes").alias("dst"), F.lit("SUPERSEDES").alias("type"))
    starts = e.select(F.col("src").alias("id")).distinct().orderBy("id").limit(20)
    return graph.k_hops(e, starts, 2, ["SUPERSEDES"]).where("hops = 2").orderBy("start", "node").limit(20)


@R("AGG22_signals", """
WITH a AS (SELECT coalesce(last_confirmed, first_seen, created_at) AS t, coalesce(last_confirmed, first_seen) IS NOT NULL AS high FROM {CUR}), b AS (SELECT *, CASE WHEN t IS NOT NULL THEN greatest(epoch_us({AS_OF}) - epoch_us(t), 0) / 86400000000.0 END AS age FROM a)
SELECT count(age) AS dated, count(*) - count(age) AS undated, round(min(age), 6) AS min_age, round(max(age), 6) AS max_age, round(avg(age), 6) AS mean_age, count(*) FILTER (high) AS high, count(*) FILTER (NOT high AND t IS NOT NULL) AS low, count(*) FILTER (t IS NULL) AS none,
round(avg(CASE WHEN high THEN 0.6 * exp(-ln(2) * age / 14) ELSE 0 END), 6) AS mean_bonus, round(max(CASE WHEN high THEN 0.6 * exp(-ln(2) * age / 14) ELSE 0 END), 6) AS max_bonus FROM b""")
def _(s, d):
    """Dated and undated rows, ages, bonus and certainty histogram in one aggregation (the median is AGG22_temporal_signals)."""
    at, sure = F.coalesce("last_confirmed", "first_seen", "created_at"), F.coalesce("last_confirmed", "first_seen").isNotNull()
    age = F.when(at.isNotNull(), temporal.age_days(at, as_of()))
    bonus = F.when(sure, 0.6 * F.exp(-F.log(F.lit(2.0)) * age / 14)).otherwise(0.0)
    c = claims(s, d, "last_confirmed", "first_seen", "created_at").select(age.alias("age"), sure.alias("high"), bonus.alias("bonus"))
    six = lambda c, n: F.round(c, 6).alias(n)
    return c.agg(F.count("age").alias("dated"), F.count_if(F.col("age").isNull()).alias("undated"), six(F.min("age"), "min_age"), six(F.max("age"), "max_age"), six(F.avg("age"), "mean_age"), F.count_if("high").alias("high"), F.count_if(~F.col("high") & F.col("age").isNotNull()).alias("low"), F.count_if(F.col("age").isNull()).alias("none"), six(F.avg("bonus"), "mean_bonus"), six(F.max("bonus"), "max_bonus"))


@R("RPT38_archived_dailies", r"SELECT doc_id, day FROM (SELECT doc_id, TRY_CAST(regexp_extract(text, '^# (\d{4}-\d{2}-\d{2})\b', 1) AS DATE) AS day FROM documents WHERE kind = 'daily_note' AND text IS NOT NULL) WHERE day IS NOT NULL AND day < DATE '2025-09-01' - INTERVAL 7 DAY".replace("doc_id, day FROM", "doc_id, CAST(day AS VARCHAR) AS day FROM", 1))
def _(s, d):
    """Daily notes whose name is a date and which are older than a week, seen from September 2025."""
    t = table(s, d, "documents").where("kind = 'daily_note' AND text IS NOT NULL").select("doc_id", F.regexp_extract("text", r"^# (\d{4}-\d{2}-\d{2})\b", 1).try_cast("date").alias("day"))
    return t.where(F.col("day") < F.lit("2025-08-25").cast("date")).select("doc_id", F.col("day").cast("string").alias("day"))


_REASONING = "['let''s think', 'step by step', 'i think', 'i suspect', 'brainstorm', 'maybe', 'might', 'could', 'perhaps', 'probably']"


@R("FLT14_without_reasoning", f"SELECT id FROM {{CUR}} WHERE len(list_filter({_REASONING}, lambda w: contains(lower(coalesce(text, '')), w))) = 0")
def _(s, d):
    """Claims that hold neither reasoning nor speculation."""
    from loamspark.functions import claims as says

    t = F.lower(F.coalesce("text", F.lit("")))
    return claims(s, d, "text").where(~says.holds_any(t, says.REASONING_WORDS) & ~says.holds_any(t, says.SPECULATION_WORDS)).select("id")


_KEY = r"array_to_string(list_filter(string_split_regex(regexp_replace(lower(trim(coalesce(text, ''), ' ')), '^(decision:|rule:|implementation pattern:|bug history:|must )\s*', ''), '[^\p{L}\p{N}]+'), lambda w: w <> ''), ' ')"


@R("FUN25_near_duplicate_neighbours", f"""
SELECT id, k = b OR ((contains(k, b) OR contains(b, k)) AND least(length(k), length(b)) >= 24) OR k = '' AS near FROM (SELECT id, k, lag(k) OVER (PARTITION BY entity, property ORDER BY id) AS b FROM (SELECT id, entity, property, {_KEY} AS k FROM {{CUR}} WHERE entity IS NOT NULL AND property IS NOT NULL AND entity <> 'general')) WHERE b IS NOT NULL""")
def _(s, d):
    """Whether a claim is nearly the same as the one before it in its slot: equal keys, or one within the other from 24 characters on; an empty key is always one."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce("text", F.lit("")))), r"^(decision:|rule:|implementation pattern:|bug history:|must )\s*", "")
    key = F.array_join(F.filter(F.split(bare, r"[^\p{L}\p{N}]+"), lambda w: w != ""), " ")
    c = claims(s, d, "entity", "property", "text").where("entity IS NOT NULL AND property IS NOT NULL AND entity <> 'general'").select("id", "entity", "property", key.alias("k"))
    c = c.withColumn("b", F.lag("k").over(Window.partitionBy("entity", "property").orderBy("id"))).where("b IS NOT NULL")
    k, b = F.col("k"), F.col("b")
    inside = (F.contains(k, b) | F.contains(b, k)) & (F.least(F.length(k), F.length(b)) >= 24)
    return c.select("id", ((k == b) | inside | (k == "")).alias("near"))


@R("GRA07_merged_links", "SELECT id AS src, supersedes AS dst, 'SUPERSEDES' AS type, max(coalesce(confidence, 0)) AS confidence FROM {CUR} WHERE supersedes IS NOT NULL GROUP BY ALL")
def _(s, d):
    """Links stored twice leave one edge each: merging is idempotent, the newest properties win."""
    c = claims(s, d, "supersedes", "confidence").where("supersedes IS NOT NULL")
    links = c.select(F.col("id").alias("src"), F.col("supersedes").alias("dst"), F.lit("SUPERSEDES").alias("type"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    once = store.upsert(links.limit(0), links, ["src", "dst", "type"])
    return store.upsert(once, links, ["src", "dst", "type"])


@R("JON12_rows_without_embedding", "SELECT id, file_path FROM code_chunks WHERE id IS NOT NULL AND id NOT IN (SELECT chunk_id FROM code_chunk_embeddings WHERE chunk_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 384)")
def _(s, d):
    """Rows without a usable embedding; an anti-join, so a null in the list takes nothing away."""
    e = table(s, d, "code_chunk_embeddings").where("embedding IS NOT NULL AND size(embedding) = 384").select(F.col("chunk_id").alias("id"))
    return table(s, d, "code_chunks").where("id IS NOT NULL").select("id", "file_path").join(e, "id", "left_anti")


@R("SRC11_note_lines_of_a_week", r"""
WITH n AS (SELECT doc_id, regexp_extract(text, '^# (\d{4}-\d{2}-\d{2})', 1) AS day, text FROM documents WHERE kind = 'daily_note' AND text IS NOT NULL), k AS (SELECT DISTINCT day FROM n WHERE day <> '' ORDER BY day DESC LIMIT 7)
SELECT doc_id, day, line FROM (SELECT doc_id, day, unnest(string_split(text, chr(10))) AS line FROM n WHERE day IN (SELECT day FROM k)) WHERE regexp_matches(line, '^(- |## |### )')""")
def _(s, d):
    """Bullets and headings of the notes of the last seven days that have any."""
    n = table(s, d, "documents").where("kind = 'daily_note' AND text IS NOT NULL").withColumn("day", F.regexp_extract("text", r"^# (\d{4}-\d{2}-\d{2})", 1)).where("day <> ''")
    week = n.select("day").distinct().orderBy(F.desc("day")).limit(7)
    lines = n.join(F.broadcast(week), "day").select("doc_id", "day", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.col("line").rlike("^(- |## |### )"))


@R("SRC13_discovered_sources", "SELECT count(*) AS files, count(DISTINCT doc_id) AS documents FROM documents WHERE kind = 'code' AND text IS NOT NULL AND source_agent IS NOT NULL")
def _(s, d):
    """Source files found by their suffix in nested folders: texts of code are written as such first, one row a file line set."""
    path = scratch(s, "sources")
    t = table(s, d, "documents").where("kind = 'code' AND text IS NOT NULL AND source_agent IS NOT NULL").select(F.to_json(F.struct("doc_id", "text")).alias("value"), F.col("source_agent").alias("agent"))
    t.write.partitionBy("agent").text(path)
    found = s.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    rows = found.select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("l")).where("l <> ''").select(F.from_json("l", "doc_id long, text string").alias("r"))
    return rows.agg(F.count(F.lit(1)).alias("files"), F.count_distinct("r.doc_id").alias("documents"))


@R("FUN42_parsed_chunks")
def _(s, d):
    """Functions, classes and methods of the code texts, nested ones too; texts that don't parse have none."""
    from loamspark.sources import files

    code = table(s, d, "documents").where("kind = 'code' AND text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("code"))
    return files.python_chunks(code)
