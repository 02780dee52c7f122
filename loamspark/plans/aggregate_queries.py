"""Queries on aggregations, windows and ordered processing (AGG, WIN, TOP)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamspark.operators import temporal
from loamspark.plans.common import Registry, as_of, claims, feedback
from loamspark.plans.join_queries import turns
from loamspark.session import table

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL



def _marks(**more):
    mark = F.col("operator_feedback")
    return [F.count(F.lit(1)).alias("n"), F.count_if(mark == "useful").alias("useful"), F.count_if(mark == "bad").alias("bad"), *[v.alias(k) for k, v in more.items()]]


_MARKS = "count(*) AS n, count(*) FILTER (operator_feedback = 'useful') AS useful, count(*) FILTER (operator_feedback = 'bad') AS bad"


@R("AGG01_feedback_stats", f"SELECT {_MARKS} FROM {{FB}} WHERE selected_id = '7'")
def _(s, d):
    return feedback(s, d).where("selected_id = '7'").agg(*_marks())


@R("AGG02_feedback_ids", "SELECT DISTINCT selected_id FROM {FB} WHERE selected_id IS NOT NULL")
def _(s, d):
    return feedback(s, d).where("selected_id IS NOT NULL").select("selected_id").distinct()


@R("AGG03_low_utility", f"SELECT selected_id, {_MARKS} FROM {{FB}} GROUP BY selected_id HAVING bad >= 3")
def _(s, d):
    return feedback(s, d).groupBy("selected_id").agg(*_marks()).where("bad >= 3")


@R("AGG04_demotion_shortlist", f"""
SELECT selected_id, {_MARKS}, count(DISTINCT CASE WHEN operator_feedback = 'bad' THEN query_text END) AS bad_queries, max(CASE WHEN operator_feedback = 'bad' THEN feedback_at END) AS last_bad,
 list_sort(list(DISTINCT CASE WHEN operator_feedback = 'bad' THEN query_text END) FILTER (operator_feedback = 'bad'))[1:3] AS samples
FROM {{FB}} GROUP BY selected_id HAVING bad >= 3 AND bad_queries >= 2 AND bad * 2 > useful""")
def _(s, d):
    bad = F.when(F.col("operator_feedback") == "bad", F.col("query_text"))
    f = feedback(s, d)
    counts = f.groupBy("selected_id").agg(*_marks(bad_queries=F.count_distinct(bad), last_bad=F.max(F.when(F.col("operator_feedback") == "bad", F.col("feedback_at")))))
    shortlist = counts.where("bad >= 3 AND bad_queries >= 2 AND bad * 2 > useful")
    w = Window.partitionBy("selected_id").orderBy("query_text")
    few = f.where("operator_feedback = 'bad' AND query_text IS NOT NULL").select("selected_id", "query_text").distinct().withColumn("r", F.row_number().over(w)).where("r <= 3")
    samples = few.groupBy("selected_id").agg(F.array_sort(F.collect_list("query_text")).alias("samples"))  # at most 3 each
    return shortlist.join(samples, "selected_id").withColumn("last_bad", F.col("last_bad").cast("timestamp_ntz"))


@R("AGG05_quality_metrics", """
SELECT count(*) AS n, count(*) FILTER (operator_feedback IS NULL) AS unmarked, count(DISTINCT selected_id) AS items, round(count(*) FILTER (operator_feedback = 'useful') / nullif(count(operator_feedback), 0), 6) AS useful_rate
FROM {FB} WHERE feedback_at >= TIMESTAMP '2024-01-15'""")
def _(s, d):
    mark = F.col("operator_feedback")
    return feedback(s, d).where(F.col("feedback_at") >= F.lit("2024-01-15").cast("timestamp")).agg(F.count(F.lit(1)).alias("n"), F.count_if(mark.isNull()).alias("unmarked"), F.count_distinct("selected_id").alias("items"), F.round(F.try_divide(F.count_if(mark == "useful"), F.count(mark)), 6).alias("useful_rate"))


@R("AGG06_top_useful", "SELECT selected_id, count(*) AS useful FROM {FB} WHERE operator_feedback = 'useful' GROUP BY selected_id ORDER BY useful DESC, selected_id LIMIT 10")
def _(s, d):
    return feedback(s, d).where("operator_feedback = 'useful'").groupBy("selected_id").agg(F.count(F.lit(1)).alias("useful")).orderBy(F.desc("useful"), "selected_id").limit(10)


@R("AGG07_by_query_type", f"SELECT coalesce(query_type, 'unknown') AS query_type, {_MARKS}, round(useful / nullif(useful + bad, 0), 6) AS useful_rate FROM {{FB}} GROUP BY coalesce(query_type, 'unknown')")
def _(s, d):
    return feedback(s, d).groupBy(F.coalesce("query_type", F.lit("unknown")).alias("query_type")).agg(*_marks()).withColumn("useful_rate", F.round(F.try_divide("useful", F.col("useful") + F.col("bad")), 6))


@R("AGG08_feedback_boost", """
SELECT selected_id, round(greatest(-0.40, least(0.25, sum(CASE operator_feedback WHEN 'useful' THEN 1.0 ELSE -1.5 END * 0.05 * power(0.5, greatest(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(feedback_at), 0) / 86400000000.0 / 30)) * least(count(*) / 3.0, 1.0))), 6) AS boost
FROM {FB} WHERE operator_feedback IS NOT NULL GROUP BY selected_id""")
def _(s, d):
    age = temporal.age_days(F.col("feedback_at"), F.lit("2024-01-31").cast("timestamp"))
    weight = F.when(F.col("operator_feedback") == "useful", 1.0).otherwise(-1.5) * 0.05 * F.pow(F.lit(0.5), age / 30)
    boost = F.sum(weight) * F.least(F.count(F.lit(1)) / 3.0, F.lit(1.0))
    return feedback(s, d).where("operator_feedback IS NOT NULL").groupBy("selected_id").agg(F.round(F.greatest(F.lit(-0.40), F.least(F.lit(0.25), boost)), 6).alias("boost"))


@R("AGG12_issues_per_item", "SELECT id, count(*) AS n FROM (SELECT item_id AS id FROM parity_issue UNION ALL SELECT report_id FROM parity_issue) GROUP BY id")
def _(s, d):
    return table(s, d, "parity_issue").select(F.explode(F.array("item_id", "report_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@R("AGG13_issue_summary", "SELECT issue_type, severity, count(*) AS n, count(DISTINCT item_id) AS items FROM parity_issue GROUP BY GROUPING SETS ((issue_type), (severity), ())")
def _(s, d):
    i = table(s, d, "parity_issue")
    return i.groupingSets([["issue_type"], ["severity"], []], "issue_type", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("items"))


@R("AGG14_quality_audit", """
SELECT count(*) AS n, count(*) FILTER (coalesce(last_confirmed, first_seen) < {AS_OF} - INTERVAL 60 DAY) AS stale, count(*) FILTER (confidence < 0.3) AS low_confidence, count(*) FILTER (coalesce(source_agent, '') = '') AS no_source,
 (SELECT count(*) FROM (SELECT entity, property FROM {CUR} WHERE coalesce(entity, '') <> '' AND coalesce(property, '') <> '' GROUP BY ALL HAVING count(*) > 1)) AS duplicate_slots FROM {CUR}""")
def _(s, d):
    c = claims(s, d, "entity", "property", "last_confirmed", "first_seen", "confidence", "source_agent")
    one = c.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("last_confirmed", "first_seen") < as_of() - F.expr("INTERVAL 60 DAYS")).alias("stale"), F.count_if(F.col("confidence") < 0.3).alias("low_confidence"), F.count_if(F.coalesce("source_agent", F.lit("")) == "").alias("no_source"))
    slots = c.where("coalesce(entity, '') <> '' AND coalesce(property, '') <> ''").groupBy("entity", "property").count().where("count > 1").agg(F.count(F.lit(1)).alias("duplicate_slots"))
    return one.crossJoin(F.broadcast(slots))  # one row each


@R("AGG16_reprocessing_plan", "SELECT count(*) AS items, count(DISTINCT source_session) AS sessions FROM {CUR} WHERE created_at >= {AS_OF} - INTERVAL 200 DAY")
def _(s, d):
    return claims(s, d, "source_session", "created_at").where(F.col("created_at") >= as_of() - F.expr("INTERVAL 200 DAYS")).agg(F.count(F.lit(1)).alias("items"), F.count_distinct("source_session").alias("sessions"))


@R("AGG18_file_status", "SELECT file_path, count(*) AS chunks, count(*) FILTER (chunk_type = 'class') AS classes, count(DISTINCT qualified_name) AS names, min(created_at) AS first_at, max(updated_at) AS last_at FROM code_chunks GROUP BY file_path")
def _(s, d):
    return table(s, d, "code_chunks").groupBy("file_path").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("chunk_type") == "class").alias("classes"), F.count_distinct("qualified_name").alias("names"), F.min("created_at").alias("first_at"), F.max("updated_at").alias("last_at"))


@R("AGG19_table_counts", "SELECT 'memory_items' AS name, count(*) AS n FROM memory_items UNION ALL SELECT 'memory_discarded', count(*) FROM memory_discarded UNION ALL SELECT 'neo4j_nodes', count(*) FROM neo4j_nodes UNION ALL SELECT 'qdrant_points', count(*) FROM qdrant_points")
def _(s, d):
    out = None
    for t in ("memory_items", "memory_discarded", "neo4j_nodes", "qdrant_points"):
        one = table(s, d, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


_AGE = "(greatest(epoch_us({AS_OF}) - epoch_us(coalesce(last_confirmed, first_seen, created_at)), 0) / 86400000000.0)"
_BUCKET = f"CASE WHEN coalesce(last_confirmed, first_seen, created_at) IS NULL THEN 'undated' WHEN {_AGE} < 1 THEN 'today' WHEN {_AGE} < 7 THEN 'this_week' WHEN {_AGE} < 31 THEN 'this_month' ELSE 'older' END"


def _aged(s, d, *more, now=None):
    at = F.coalesce("last_confirmed", "first_seen", "created_at")
    return claims(s, d, "last_confirmed", "first_seen", "created_at", *more).withColumns({"at_ts": at, "age": temporal.age_days(at, as_of() if now is None else now)})


@R("AGG22_temporal_signals", f"SELECT count({_AGE}) AS dated, round(min({_AGE}), 6) AS least, round(max({_AGE}), 6) AS most, round(avg({_AGE}), 6) AS mean, round(median({_AGE}), 6) AS middle FROM {{CUR}} WHERE coalesce(last_confirmed, first_seen, created_at) IS NOT NULL")
def _(s, d):
    r = lambda f, n: F.round(f("age"), 6).alias(n)
    return _aged(s, d).where("age IS NOT NULL").agg(F.count("age").alias("dated"), r(F.min, "least"), r(F.max, "most"), r(F.avg, "mean"), r(F.median, "middle"))


_CONS = f"""SELECT resolution, scope, entity_key, count(*) AS n, min(t) AS first_at, max(t) AS last_at FROM (
SELECT scope, coalesce(last_confirmed, first_seen, created_at) AS t, CASE WHEN {_AGE} < 30 THEN 'daily' WHEN {_AGE} < 90 THEN 'weekly' ELSE 'monthly' END AS resolution,
 CASE WHEN {_AGE} < 30 THEN coalesce(entity, '') ELSE '' END AS entity_key,
 CASE WHEN {_AGE} < 30 THEN strftime(coalesce(last_confirmed, first_seen, created_at) AT TIME ZONE 'UTC', '%Y-%m-%d') WHEN {_AGE} < 90 THEN strftime(date_trunc('week', coalesce(last_confirmed, first_seen, created_at) AT TIME ZONE 'UTC'), '%Y-%m-%d') ELSE strftime(coalesce(last_confirmed, first_seen, created_at) AT TIME ZONE 'UTC', '%Y-%m') END AS period
FROM {{CUR}} WHERE {_AGE} >= 7) GROUP BY resolution, scope, entity_key, period HAVING count(*) >= 3"""


def _consolidation(s, d):
    age, at = F.col("age"), F.col("at_ts")
    resolution = F.when(age < 30, "daily").when(age < 90, "weekly").otherwise("monthly")
    period = F.when(age < 30, F.date_format(at, "yyyy-MM-dd")).when(age < 90, F.date_format(F.date_trunc("week", at), "yyyy-MM-dd")).otherwise(F.date_format(at, "yyyy-MM"))
    c = _aged(s, d, "scope", "entity").where("age >= 7").select("scope", "at_ts", resolution.alias("resolution"), period.alias("period"), F.when(age < 30, F.coalesce("entity", F.lit(""))).otherwise("").alias("entity_key"))
    return c.groupBy("resolution", "scope", "entity_key", "period").agg(F.count(F.lit(1)).alias("n"), F.min("at_ts").alias("first_at"), F.max("at_ts").alias("last_at")).where("n >= 3")


@R("AGG23_consolidation_groups", _CONS)
def _(s, d):
    return _consolidation(s, d).drop("period")


@R("AGG24_consolidation_plan", f"SELECT resolution, count(*) AS groups, CAST(sum(n) AS BIGINT) AS items FROM ({_CONS}) GROUP BY resolution")
def _(s, d):
    return _consolidation(s, d).groupBy("resolution").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("items"))


@R("AGG28_compaction", """
SELECT scope, memory_type, entity, property, tags_key, count(*) AS n, least(1.0, round(max(confidence) + 0.05, 6)) AS confidence, min(id) AS keeper FROM (
SELECT *, array_to_string(list_sort(coalesce(tags, [])), ',') AS tags_key FROM {CUR} WHERE lifecycle_state IN ('durable', 'reinforced')) GROUP BY ALL HAVING count(*) > 1""".replace("SELECT *, array", "SELECT id, scope, memory_type, entity, property, confidence, array").replace("GROUP BY ALL", "GROUP BY scope, memory_type, entity, property, tags_key"))
def _(s, d):
    c = claims(s, d, "scope", "memory_type", "entity", "property", "tags", "confidence", "lifecycle_state").where(F.col("lifecycle_state").isin("durable", "reinforced"))
    c = c.withColumn("tags_key", F.array_join(F.array_sort(F.coalesce("tags", F.array().cast("array<string>"))), ","))
    return c.groupBy("scope", "memory_type", "entity", "property", "tags_key").agg(F.count(F.lit(1)).alias("n"), F.least(F.lit(1.0), F.round(F.max("confidence") + 0.05, 6)).alias("confidence"), F.min("id").alias("keeper")).where("n > 1")


@R("AGG30_metric_summary", "SELECT metric, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS most FROM (SELECT unnest(['confidence', 'importance']) AS metric, unnest([confidence, importance]) AS v FROM {CUR}) GROUP BY metric")
def _(s, d):
    u = claims(s, d, "confidence", "importance").unpivot("id", ["confidence", "importance"], "metric", "v")
    return u.groupBy("metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"))


@R("AGG31_latency_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def _(s, d):
    e = table(s, d, "events").groupBy("event_type")
    return e.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.round(F.avg("value"), 6).alias("mean"))


@R("AGG36_high_water_mark", "SELECT max(TRY_CAST(regexp_replace(source_session, '^ses-', '') AS BIGINT)) AS mark FROM memory_items WHERE source_session LIKE 'ses-%'")
def _(s, d):
    return table(s, d, "memory_items").where("source_session LIKE 'ses-%'").agg(F.max(F.regexp_replace("source_session", "^ses-", "").try_cast("long")).alias("mark"))


@R("AGG37_weight_shift", f"SELECT useful + bad AS marked, round(useful / nullif(useful + bad, 0), 6) AS quality, CASE WHEN useful < 0.5 * (useful + bad) THEN 0.5 ELSE 0.4 END AS fts_weight FROM (SELECT {_MARKS} FROM {{FB}})")
def _(s, d):
    m = feedback(s, d).agg(*_marks())
    marked = F.col("useful") + F.col("bad")
    return m.select(marked.alias("marked"), F.round(F.try_divide("useful", marked), 6).alias("quality"), F.when(F.col("useful") < 0.5 * marked, 0.5).otherwise(0.4).alias("fts_weight"))


@R("WIN01_relative_recency", """
SELECT id, round(CASE WHEN coalesce(entity, '') = '' OR coalesce(property, '') = '' THEN 0 ELSE 0.8 * (1 - coalesce((row_number() OVER w - 1) / nullif(count(*) OVER (PARTITION BY entity, property) - 1, 0), 0)) END, 6) AS recency
FROM {CUR} WINDOW w AS (PARTITION BY entity, property ORDER BY coalesce(last_confirmed, first_seen, TIMESTAMPTZ '1970-01-01 00:00:00+00') DESC, id)""")
def _(s, d):
    # rows without a slot score 0 and needn't meet in one task
    c = claims(s, d, "entity", "property", "last_confirmed", "first_seen")
    slot = (F.coalesce("entity", F.lit("")) != "") & (F.coalesce("property", F.lit("")) != "")
    w = Window.partitionBy("entity", "property")
    place = F.row_number().over(w.orderBy(F.desc(F.coalesce("last_confirmed", "first_seen", F.timestamp_seconds(F.lit(0)))), "id")) - 1
    ranked = c.where(slot).select("id", F.round(0.8 * (1 - F.coalesce(F.try_divide(place, F.count(F.lit(1)).over(w) - 1), F.lit(0.0))), 6).alias("recency"))
    return ranked.unionByName(c.where(~slot).select("id", F.lit(0.0).alias("recency")))


@R("WIN03_newest_per_slot", """
SELECT id FROM {CUR} WHERE coalesce(entity, '') <> '' AND coalesce(property, '') <> '' QUALIFY row_number() OVER (PARTITION BY lower(trim(entity)), lower(trim(property)) ORDER BY last_confirmed DESC NULLS LAST, id) = 1""")
def _(s, d):
    w = Window.partitionBy(F.lower(F.trim("entity")), F.lower(F.trim("property"))).orderBy(F.desc_nulls_last("last_confirmed"), "id")
    c = claims(s, d, "entity", "property", "last_confirmed").where("coalesce(entity, '') <> '' AND coalesce(property, '') <> ''")
    return c.withColumn("r", F.row_number().over(w)).where("r = 1").select("id")


@R("WIN05_balanced_recency", "SELECT id, round(0.6 * coalesce(confidence, 0) + 0.4 * (1 - (row_number() OVER (PARTITION BY source_session ORDER BY created_at DESC NULLS LAST, id) - 1) / count(*) OVER (PARTITION BY source_session)), 6) AS score FROM {CUR}")
def _(s, d):
    w = Window.partitionBy("source_session")
    rank = F.row_number().over(w.orderBy(F.desc_nulls_last("created_at"), "id")) - 1
    return claims(s, d, "confidence", "source_session", "created_at").select("id", F.round(0.6 * F.coalesce("confidence", F.lit(0.0)) + 0.4 * (1 - rank / F.count(F.lit(1)).over(w)), 6).alias("score"))


@R("WIN06_turn_windows", """
SELECT session_id, turn_index, ids FROM (SELECT session_id, turn_index, list(doc_id) OVER (PARTITION BY session_id ORDER BY turn_index ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS ids FROM {TURNS}) WHERE (turn_index - 1) % 2 = 0""")
def _(s, d):
    w = Window.partitionBy("session_id").orderBy("turn_index").rowsBetween(0, 2)
    return turns(s, d).select("session_id", "turn_index", F.collect_list("doc_id").over(w).alias("ids")).where("(turn_index - 1) % 2 = 0")


@R("WIN07_word_windows")
def _(s, d):
    """Windows of 100 words that overlap by 25, in order, until the last word is covered."""
    words = F.filter(F.split("text", "\\s+"), lambda x: x != "")
    t = table(s, d, "documents").select("doc_id", words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 26, F.lit(0)), F.lit(75))
    return t.select("doc_id", "w", F.posexplode(starts).alias("chunk", "at")).select("doc_id", "chunk", F.array_join(F.slice("w", F.col("at") + 1, F.lit(100)), " ").alias("text"))


@R("WIN09_runs_of_kind", """
SELECT user_id, event_type, grp, count(*) AS n FROM (SELECT user_id, event_type, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS grp FROM (
SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM events)) GROUP BY ALL""")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(s, d, "events").select("user_id", "event_id", "event_type", (~F.lag("event_type").over(w).eqNullSafe(F.col("event_type"))).cast("long").alias("new"))
    return e.withColumn("grp", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "event_type", "grp").agg(F.count(F.lit(1)).alias("n"))


@R("WIN11_cascade_flag", "SELECT id, chunk_type <> first_value(chunk_type) OVER (PARTITION BY file_path ORDER BY line_start, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS later FROM code_chunks")
def _(s, d):
    w = Window.partitionBy("file_path").orderBy("line_start", "id").rowsBetween(Window.unboundedPreceding, 0)
    return table(s, d, "code_chunks").select("id", (F.col("chunk_type") != F.first("chunk_type").over(w)).alias("later"))


@R("TOP13_random_baseline")
def _(s, d):
    """A repeatable random order: by hash of the id and a seed."""
    return table(s, d, "documents").select("source").distinct().orderBy(F.xxhash64("source", F.lit(42)), "source").limit(10)


@R("TOP14_recency_baseline", "SELECT source, max(captured_at) AS newest FROM documents WHERE captured_at IS NOT NULL GROUP BY source ORDER BY newest DESC, source LIMIT 10")
def _(s, d):
    return table(s, d, "documents").where("captured_at IS NOT NULL").groupBy("source").agg(F.max("captured_at").alias("newest")).orderBy(F.desc("newest"), "source").limit(10)


@R("TOP07_best_match", "SELECT entity, arg_max(id, struct_pack(c := coalesce(confidence, -1), i := id)) AS best FROM {CUR} WHERE coalesce(entity, '') <> '' GROUP BY entity")
def _(s, d):
    return claims(s, d, "entity", "confidence").where("coalesce(entity, '') <> ''").groupBy("entity").agg(F.max_by("id", F.struct(F.coalesce("confidence", F.lit(-1.0)), "id")).alias("best"))
