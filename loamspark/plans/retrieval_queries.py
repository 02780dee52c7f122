"""Queries on hybrid retrieval, its scores, text functions and evaluation (TOP, SCO, FUN, EVA, UDF)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamspark.operators import retrieval, temporal
from loamspark.plans.common import Registry, as_of, claims
from loamspark.session import table

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL

QUESTION = "Which compiler warnings superseded the archived snapshot?"
TERMS = retrieval.query_terms(QUESTION)
SHORT = retrieval.query_terms("compiler warnings")

_TOK = "list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9_ ]', ' ', 'g'), ' +'), lambda x: x <> '')"
_BONUS = " + ".join(f"CASE WHEN list_contains({_TOK.format(f)}, '{t}') THEN {w} ELSE 0 END" for f, w in retrieval.FIELD_WEIGHTS.items() for t in TERMS)
_AGE = "(greatest(epoch_us({AS_OF}) - epoch_us({0}), 0) / 86400000000.0)"
_AGE1 = _AGE.replace("{0}", "coalesce(last_confirmed, first_seen, created_at)")
_REC = f"coalesce(exp(-ln(2) * {_AGE1} / 30), 0)"
_HELD = f"list_transform({_TOK.format('text')}, lambda x: regexp_replace(x, '(ies|es|s|ing|ed)$', ''))"


def _rank_sql(terms):
    import re

    stems = [re.sub(r"(ies|es|s|ing|ed)$", "", t) for t in terms]
    return f"CASE WHEN {' AND '.join(f'''list_contains({_HELD}, '{t}')''' for t in stems)} THEN {float(len(stems))} / (1 + ln(1 + len({_HELD}))) ELSE 0 END"


def _age(at):
    return temporal.age_days(at, as_of())


@R("SCO02_overlap_bonus", f"SELECT id, round({_BONUS}, 6) AS bonus FROM {{CUR}}")
def _(s, d):
    return claims(s, d, "text", "entity", "property", "value").select("id", F.round(retrieval.overlap_bonus(TERMS), 6).alias("bonus"))


@R("SCO03_vector_score", """
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, q""")
def _(s, d):
    e = table(s, d, "embeddings")
    q = e.orderBy("vec_id").limit(1).select("embedding").first()
    return retrieval.similarity(e, "vec_id", "embedding", q[0] if q else [1.0]).withColumn("score", F.round("score", 6))


@R("SCO06_recency_30", f"SELECT id, round(0.6 * {_REC}, 6) AS recency FROM {{CUR}}")
def _(s, d):
    at = F.coalesce("last_confirmed", "first_seen", "created_at")
    return claims(s, d, "last_confirmed", "first_seen", "created_at").select("id", F.round(temporal.half_life(_age(at), 30.0, 0.6), 6).alias("recency"))


@R("SCO07_recency_14", "SELECT id, round(CASE WHEN coalesce(last_confirmed, first_seen) IS NULL THEN 0 ELSE 0.6 * power(0.5, " + _AGE.replace("{0}", "coalesce(last_confirmed, first_seen)") + " / 14) END, 6) AS recency FROM {CUR}")
def _(s, d):
    return claims(s, d, "last_confirmed", "first_seen").select("id", F.round(temporal.half_life(_age(F.coalesce("last_confirmed", "first_seen")), 14.0, 0.6), 6).alias("recency"))


@R("TOP05_vector_topk", """
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10""")
def _(s, d):
    e = table(s, d, "embeddings")
    q = e.orderBy("vec_id").limit(1).select("embedding").first()
    return retrieval.similarity(e, "vec_id", "embedding", q[0] if q else [1.0]).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "vec_id").limit(10)


@R("SCO11_effective_ts", "SELECT id, coalesce(last_confirmed, first_seen, created_at) AS at_ts, CASE WHEN coalesce(last_confirmed, first_seen) IS NOT NULL THEN 'high' WHEN created_at IS NOT NULL THEN 'low' ELSE 'none' END AS certainty FROM {CUR}")
def _(s, d):
    sure = F.when(F.coalesce("last_confirmed", "first_seen").isNotNull(), "high").when(F.col("created_at").isNotNull(), "low").otherwise("none")
    return claims(s, d, "last_confirmed", "first_seen", "created_at").select("id", F.coalesce("last_confirmed", "first_seen", "created_at").alias("at_ts"), sure.alias("certainty"))


@R("SCO13_buckets", f"SELECT id, CASE WHEN {_AGE1} IS NULL THEN 'undated' WHEN {_AGE1} < 1 THEN 'today' WHEN {_AGE1} < 7 THEN 'this_week' WHEN {_AGE1} < 31 THEN 'this_month' ELSE 'older' END AS bucket FROM {{CUR}}".replace("coalesce(last_confirmed, first_seen, created_at)", "last_confirmed").replace(f"{_AGE1} IS NULL".replace("coalesce(last_confirmed, first_seen, created_at)", "last_confirmed"), "last_confirmed IS NULL"))
def _(s, d):
    return claims(s, d, "last_confirmed").select("id", temporal.bucket(_age(F.col("last_confirmed"))).alias("bucket"))


@R("SCO14_labels", """
WITH a AS (SELECT id, """ + _AGE.replace("{0}", "last_confirmed") + """ AS age, last_confirmed FROM {CUR})
SELECT id, CASE WHEN last_confirmed IS NULL THEN 'undated' WHEN age * 24 < 1 THEN 'just now' WHEN age < 1 THEN CAST(CAST(round_even(age * 24, 0) AS BIGINT) AS VARCHAR) || ' hours ago' WHEN age < 7 THEN CAST(CAST(round_even(age, 0) AS BIGINT) AS VARCHAR) || ' days ago'
 WHEN age < 31 THEN CAST(CAST(round_even(age / 7, 0) AS BIGINT) AS VARCHAR) || ' weeks ago' WHEN age < 365 THEN CAST(CAST(round_even(age / 30, 0) AS BIGINT) AS VARCHAR) || ' months ago' ELSE CAST(CAST(round_even(age / 365, 0) AS BIGINT) AS VARCHAR) || ' years ago' END AS label FROM a""")
def _(s, d):
    return claims(s, d, "last_confirmed").select("id", temporal.label(_age(F.col("last_confirmed"))).alias("label"))


@R("SCO17_log_decay", """
WITH a AS (SELECT id, """ + _AGE.replace("{0}", "last_confirmed") + """ AS age, last_confirmed FROM {CUR})
SELECT id, round(CASE WHEN last_confirmed IS NULL THEN 0 ELSE CASE WHEN age <= 1 THEN 0.10 ELSE 0.10 / (1 + log2(1 + age / 14)) END + CASE WHEN age > 60 THEN -0.08 * least((age - 60) / 180, 1.0) ELSE 0 END END, 6) AS score FROM a""")
def _(s, d):
    return claims(s, d, "last_confirmed").select("id", F.round(temporal.log_decay(_age(F.col("last_confirmed"))), 6).alias("score"))


@R("SCO18_window_match", "SELECT id, CASE WHEN last_confirmed BETWEEN TIMESTAMPTZ '2026-01-01 00:00:00+00' AND TIMESTAMPTZ '2026-02-01 00:00:00+00' THEN 0.12 ELSE 0 END AS bonus FROM {CUR}")
def _(s, d):
    inside = F.col("last_confirmed").between(F.lit("2026-01-01").cast("timestamp"), F.lit("2026-02-01").cast("timestamp"))
    return claims(s, d, "last_confirmed").select("id", F.when(inside, 0.12).otherwise(0.0).alias("bonus"))


@R("FUN01_parse_times", "SELECT event_id, epoch_us(CAST(strftime(ts, '%Y-%m-%dT%H:%M:%S') AS TIMESTAMP)) AS at_us FROM events")
def _(s, d):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    at = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    return table(s, d, "events").select("event_id", F.unix_micros(at).alias("at_us"))


@R("FUN04_period_keys", "SELECT event_id, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day, CAST(week(ts) AS BIGINT) AS iso_week, strftime(date_trunc('week', ts), '%Y-%m-%d') AS monday FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM").alias("month"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.weekofyear("ts").cast("long").alias("iso_week"), F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("monday"))


_KINDS = {"code": "function|class|import|compile|error|module", "timeline": "when|yesterday|today|week|month|ago", "memory": "remember|memory|decision|claim|prefer"}


@R("FUN11_question_types", "SELECT item_id, CASE WHEN regexp_matches(lower(question), '\\bwhen\\b') THEN 'when' WHEN regexp_matches(lower(question), '\\bwhere\\b') THEN 'where' WHEN regexp_matches(lower(question), '\\bwho\\b') THEN 'who' WHEN regexp_matches(lower(question), '\\bhow (many|much)\\b') THEN 'quantity' ELSE 'what' END AS kind FROM eval_items")
def _(s, d):
    q = lambda p: F.lower("question").rlike(rf"\b{p}\b")
    return table(s, d, "eval_items").select("item_id", F.when(q("when"), "when").when(q("where"), "where").when(q("who"), "who").when(q("how (many|much)"), "quantity").otherwise("what").alias("kind"))


@R("FUN24_token_counts", "SELECT doc_id, greatest(1, length(text) // 4) AS n FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long").alias("n"))


@R("FUN27_content_hash", "SELECT id, substr(sha256(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))), 1, 16) AS h FROM {CUR} WHERE text IS NOT NULL")
def _(s, d):
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z0-9 ]", ""), " +", " "))
    return claims(s, d, "text").where("text IS NOT NULL").select("id", F.substring(F.sha2(t, 256), 1, 16).alias("h"))


@R("FUN36_cosine_pairs", """
SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(s, d):
    e = table(s, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.select("vec_id", "embedding").join(b, "vec_id").select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


@R("FUN37_set_overlap", f"SELECT item_id, round(len(list_intersect(a, b)) / len(a), 6) AS share FROM (SELECT item_id, list_distinct({_TOK.format('question')}) AS a, list_distinct({_TOK.format('text')}) AS b FROM eval_items) WHERE len(a) > 0")
def _(s, d):
    a, b = (F.array_distinct(retrieval.tokens(F.col(c))) for c in ("question", "text"))
    return table(s, d, "eval_items").select("item_id", a.alias("a"), b.alias("b")).where(F.size("a") > 0).select("item_id", F.round(F.size(F.array_intersect("a", "b")) / F.size("a"), 6).alias("share"))


@R("FUN40_deterministic_ids", "SELECT id, substr(sha256(concat_ws('|', file_path, chunk_type, qualified_name)), 1, 16) AS chunk_key FROM code_chunks")
def _(s, d):
    return table(s, d, "code_chunks").select("id", F.substring(F.sha2(F.concat_ws("|", "file_path", "chunk_type", "qualified_name"), 256), 1, 16).alias("chunk_key"))


@R("FUN41_vocabulary_default", "SELECT id, CASE freshness_class WHEN 'stable' THEN 1.0 WHEN 'slow' THEN 0.7 WHEN 'volatile' THEN 0.3 ELSE 0.5 END AS weight FROM {CUR}")
def _(s, d):
    weights = F.create_map(*[F.lit(x) for kv in {"stable": 1.0, "slow": 0.7, "volatile": 0.3}.items() for x in kv])
    return claims(s, d, "freshness_class").select("id", F.coalesce(F.try_element_at(weights, "freshness_class"), F.lit(0.5)).alias("weight"))


@R("FUN45_embedding_text", "SELECT id, md5(substr(concat_ws(chr(10), qualified_name, signature, docstring, body), 1, 1000)) AS h FROM code_chunks")
def _(s, d):
    return table(s, d, "code_chunks").select("id", F.md5(F.concat_ws("\n", "qualified_name", "signature", "docstring", "body")).alias("h"))


_RANKED = """(SELECT label AS query, vec_id AS item, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings)"""
_REL = "(SELECT label AS query, vec_id AS item, CAST(vec_id % 3 AS DOUBLE) AS gain FROM embeddings WHERE vec_id % 3 > 0)"


def _run(s, d):
    e = table(s, d, "embeddings")
    w = Window.partitionBy("label").orderBy(F.desc(F.col("embedding")[0]), "vec_id")
    ranked = e.select(F.col("label").alias("query"), F.col("vec_id").alias("item"), F.row_number().over(w).alias("rank"))
    return ranked, e.where("vec_id % 3 > 0").select(F.col("label").alias("query"), F.col("vec_id").alias("item"), (F.col("vec_id") % 3).cast("double").alias("gain"))


def _metrics_sql(k: int) -> str:
    return f"""SELECT q.query, round(coalesce(h.hits / i.wanted, 0), 6) AS recall, round(coalesce(h.hits / {k}.0, 0), 6) AS precision, round(coalesce(1.0 / h.first, 0), 6) AS mrr, round(coalesce(h.dcg / i.ideal, 0), 6) AS ndcg FROM (SELECT DISTINCT query FROM {_RANKED}) q
LEFT JOIN (SELECT query, count(*) AS wanted, sum(CASE WHEN r <= {k} THEN gain / log2(r + 1) END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY gain DESC, item) AS r FROM {_REL}) GROUP BY query) i USING (query)
LEFT JOIN (SELECT query, count(*) AS hits, min(rank) AS first, sum(gain / log2(rank + 1)) AS dcg FROM {_RANKED} JOIN {_REL} USING (query, item) WHERE rank <= {k} GROUP BY query) h USING (query)"""


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@R("EVA01_metrics_at_10", _metrics_sql(10))
def _(s, d):
    return _rounded(retrieval.metrics_at(*_run(s, d), "query", "item", 10))


@R("EVA03_metrics_at_several_k", " UNION ALL ".join(f"SELECT {k} AS k, * FROM ({_metrics_sql(k)})" for k in (1, 3, 5, 10)))
def _(s, d):
    out = None
    for k in (1, 3, 5, 10):
        one = _rounded(retrieval.metrics_at(*_run(s, d), "query", "item", k)).withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


@R("EVA04_regression_check", f"SELECT a.query, round(b.recall - a.recall, 6) AS change, b.recall < a.recall * 0.95 AS regressed FROM ({_metrics_sql(10)}) a JOIN ({_metrics_sql(5)}) b USING (query)")
def _(s, d):
    a, b = (_rounded(retrieval.metrics_at(*_run(s, d), "query", "item", k)).select("query", F.col("recall").alias(n)) for k, n in ((10, "before"), (5, "now")))
    return a.join(b, "query").select("query", F.round(F.col("now") - F.col("before"), 6).alias("change"), (F.col("now") < F.col("before") * 0.95).alias("regressed"))


@R("EVA05_bootstrap_interval")
def _(s, d):
    """95 % interval of the mean by 1,000 resamples; draws are hashes of (resample, place), so they can be repeated.

    Resampling with replacement is simulated by Poisson(1) weights, which need no index into the data: one pass.
    """
    e = table(s, d, "events").where("value IS NOT NULL").groupBy(F.pmod(F.xxhash64("event_id"), F.lit(1000)).alias("block")).agg(F.sum("value").alias("t"), F.count(F.lit(1)).alias("n"))
    u = (F.pmod(F.xxhash64("block", "draw"), F.lit(1 << 30)) / float(1 << 30)).alias("u")
    w = F.when(F.col("u") < 0.36788, 0).when(F.col("u") < 0.73576, 1).when(F.col("u") < 0.91970, 2).when(F.col("u") < 0.98101, 3).when(F.col("u") < 0.99634, 4).when(F.col("u") < 0.99941, 5).when(F.col("u") < 0.99992, 6).otherwise(7)
    drawn = e.crossJoin(F.broadcast(s.range(1000).withColumnRenamed("id", "draw"))).select("t", "n", "draw", u)  # 1,000 blocks and 1,000 draws, however large the data
    means = drawn.groupBy("draw").agg((F.sum(F.col("t") * w) / F.sum(F.col("n") * w)).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


@R("EVA06_permutation_test")
def _(s, d):
    """Share of 5,000 random sign flips of paired differences whose mean is at least as far from 0."""
    e = table(s, d, "embeddings").groupBy("label").agg((F.avg(F.col("embedding")[0]) - F.avg(F.col("embedding")[1])).alias("diff"))
    seen = e.agg(F.abs(F.avg("diff")).alias("seen"))
    sign = F.when(F.pmod(F.xxhash64("label", "flip"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    flips = e.crossJoin(F.broadcast(s.range(5000).withColumnRenamed("id", "flip"))).groupBy("flip").agg(F.abs(F.avg(F.col("diff") * sign)).alias("m"))
    return flips.crossJoin(F.broadcast(seen)).agg(F.avg((F.col("m") >= F.col("seen")).cast("double")).alias("p"))


@R("EVA07_cohens_d", """
WITH s AS (SELECT avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'click') AS b, var_samp(value) FILTER (event_type = 'view') AS va, var_samp(value) FILTER (event_type = 'click') AS vb, count(value) FILTER (event_type = 'view') AS na, count(value) FILTER (event_type = 'click') AS nb FROM events)
SELECT round((a - b) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS d FROM s""")
def _(s, d):
    of = lambda k: F.when(F.col("event_type") == k, F.col("value"))
    x = table(s, d, "events").agg(*[f(of(k)).alias(n + c) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count)) for k, c in (("view", "a"), ("click", "b"))])
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    return x.select(F.round(F.try_divide(F.col("ma") - F.col("mb"), pooled), 6).alias("d"))


@R("EVA08_grouped_metrics", "SELECT coalesce(event_type, 'ALL') AS grp, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), ())")
def _(s, d):
    e = table(s, d, "events").groupingSets([["event_type"], []], "event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))
    return e.select(F.coalesce("event_type", F.lit("ALL")).alias("grp"), "mean", "n")


@R("UDF06_multimodal_text", "SELECT doc_id, '[' || coalesce(kind, 'text') || '] ' || coalesce(source, '') AS label FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.concat(F.lit("["), F.coalesce("kind", F.lit("text")), F.lit("] "), F.coalesce("source", F.lit(""))).alias("label"))
