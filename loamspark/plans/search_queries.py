"""Hybrid retrieval with vectors and full-text rank over the store's claims (SCO, TOP, JON03, FLT02-03, RPT11-12, RPT36)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamspark.operators import retrieval, search, temporal
from loamspark.plans.common import Registry, as_of, claims
from loamspark.session import table

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL

QUESTION = "snapshot owner"
_FIELDS = "text entity property value memory_type scope status sensitivity confidence importance source_agent last_confirmed first_seen created_at".split()


def _tok(c: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9_ ]', ' ', 'g'), ' +'), lambda x: x <> '')"


#: vec: cosine with the question's hashed tokens; fts: runs of the two stemmed words; bonus: whole tokens in four fields.
PARTS = f"""
tok AS (SELECT id, unnest({_tok('text')}) AS t FROM c),
cell AS (SELECT id, h % 64 AS p, sum(CASE WHEN s < 8 THEN 1.0 ELSE -1.0 END) AS x FROM (SELECT id, CAST('0x' || substr(md5(t), 1, 7) AS BIGINT) AS h, CAST('0x' || substr(md5(t), 9, 1) AS BIGINT) AS s FROM tok) GROUP BY ALL),
q AS (SELECT h % 64 AS p, sum(CASE WHEN s < 8 THEN 1.0 ELSE -1.0 END) AS x FROM (SELECT CAST('0x' || substr(md5(t), 1, 7) AS BIGINT) AS h, CAST('0x' || substr(md5(t), 9, 1) AS BIGINT) AS s FROM (SELECT unnest(['snapshot', 'owner']) AS t)) GROUP BY ALL),
vec AS (SELECT id, coalesce(sum(cell.x * coalesce(q.x, 0)) / nullif(sqrt(sum(cell.x * cell.x)) * (SELECT sqrt(sum(x * x)) FROM q), 0), 0) AS v FROM cell LEFT JOIN q USING (p) GROUP BY id),
pos AS (SELECT id, i, w FROM (SELECT id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT id, list_transform({_tok("concat_ws(' ', coalesce(text, ''), coalesce(entity, ''), coalesce(property, ''), coalesce(value, ''), coalesce(memory_type, ''), coalesce(scope, ''))")}, lambda x: regexp_replace(x, '(ies|es|s|ing|ed)$', '')) AS ws FROM c)) WHERE w IN ('snapshot', 'owner')),
fts AS (SELECT id, sum(0.1 / (i - j)) AS f FROM (SELECT id, i, w, lag(i) OVER (PARTITION BY id ORDER BY i) AS j, lag(w) OVER (PARTITION BY id ORDER BY i) AS u FROM pos) WHERE u <> w GROUP BY id),
sc AS (SELECT c.*, v, coalesce(f, 0) AS f,
 0.18 * (CAST(list_contains({_tok('text')}, 'snapshot') AS INT) + CAST(list_contains({_tok('text')}, 'owner') AS INT)) + 0.20 * (CAST(list_contains({_tok('entity')}, 'snapshot') AS INT) + CAST(list_contains({_tok('entity')}, 'owner') AS INT))
 + 0.45 * (CAST(list_contains({_tok('property')}, 'snapshot') AS INT) + CAST(list_contains({_tok('property')}, 'owner') AS INT)) + 0.55 * (CAST(list_contains({_tok('value')}, 'snapshot') AS INT) + CAST(list_contains({_tok('value')}, 'owner') AS INT)) AS b,
 CASE WHEN coalesce(last_confirmed, first_seen, created_at) IS NULL THEN 0 ELSE exp(-ln(2) * greatest(epoch_us({{AS_OF}}) - epoch_us(coalesce(last_confirmed, first_seen, created_at)), 0) / 86400000000.0 / 30) END AS r
 FROM c JOIN vec USING (id) LEFT JOIN fts USING (id))"""
_FINAL = "3.0 * f + 1.1 * v + b + 0.2 + 0.6 * r"
_ORDER = "score DESC, confidence DESC NULLS LAST, importance DESC NULLS LAST, last_confirmed DESC NULLS LAST, id"


def _with(where: str) -> str:
    return "WITH c AS (SELECT * FROM {CUR} WHERE " + where + ")," + PARTS


def parts(s, d, where: str, question: str = QUESTION):
    """Claims under a condition with fts, vector, structured and recency, the parts of the final score."""
    c = claims(s, d, *_FIELDS).where(where)
    at = F.coalesce("last_confirmed", "first_seen", "created_at")
    # one query side: its vector and terms go to the tasks as literals
    rows = c.join(search.vector_scores(c, "id", "text", question), "id")
    return rows.withColumns({"fts": search.text_rank(question), "structured": retrieval.overlap_bonus(search.term_list(question)), "recency": temporal.half_life(temporal.age_days(at, as_of()), 30.0, 1.0)})


def _ranked(df, score):
    return df.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), F.desc_nulls_last("confidence"), F.desc_nulls_last("importance"), F.desc_nulls_last("last_confirmed"), "id")


_SCORE = search.final_score
_OF = lambda: _SCORE(F.col("fts"), F.col("vector"), F.col("structured"), F.col("recency"))


def hybrid(s, d, limit: int = 20):
    """The best active claims of a reader's sensitivities, by the final score; ties by confidence, importance, recency, id."""
    return _ranked(parts(s, d, "status = 'active' AND sensitivity IN ('public', 'internal')"), _OF()).limit(limit).select("id", "score")


_OPEN = "status = 'active' AND sensitivity IN ('public', 'internal')"


@R("SCO01_query_terms", """
SELECT item_id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(question), '[^a-z0-9_ ]', ' ', 'g'), ' +'), lambda x: length(x) >= 4 AND x NOT IN ('this', 'that', 'with', 'from', 'into', 'they', 'them', 'then', 'than', 'have', 'will', 'would', 'could', 'should', 'there', 'their', 'about', 'because', 'system'))) AS term, FALSE AS filtered FROM eval_items WHERE question IS NOT NULL
UNION ALL SELECT item_id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(question), '[^a-z0-9_ ]', ' ', 'g'), ' +'), lambda x: length(x) >= 4 AND x NOT IN ('this', 'that', 'with', 'from', 'into', 'they', 'them', 'then', 'than', 'have', 'will', 'would', 'could', 'should', 'there', 'their', 'about', 'because', 'system', 'person', 'does', 'what', 'where', 'love', 'enjoy'))), TRUE FROM eval_items WHERE question IS NOT NULL""")
def _(s, d):
    q = table(s, d, "eval_items").where("question IS NOT NULL")
    one = lambda stop, flag: q.select("item_id", F.explode(search.terms(F.col("question"), stop)).alias("term"), F.lit(flag).alias("filtered"))
    return one(retrieval.STOP_WORDS, False).unionByName(one(search.FILTERED_STOP_WORDS, True))


@R("SCO04_fts_rank", _with("TRUE") + " SELECT id, round(f, 6) AS fts FROM fts")
def _(s, d):
    c = claims(s, d, *search.TEXT_FIELDS)
    return c.select("id", F.round(search.text_rank(QUESTION), 6).alias("fts")).where("fts > 0")


@R("SCO05_importance_bonus", "SELECT id, 0.8 * 0.25 AS bonus FROM {CUR}")
def _(s, d):
    return claims(s, d, "status").select("id", F.lit(0.2).alias("bonus"))


@R("SCO08_final_score", _with(_OPEN) + f" SELECT id, round({_FINAL}, 6) AS score FROM sc")
def _(s, d):
    return parts(s, d, _OPEN).select("id", F.round(_OF(), 6).alias("score"))


_RELATIVE = """CASE WHEN entity IS NULL OR property IS NULL THEN 0 ELSE 0.8 * (1 - coalesce((row_number() OVER (PARTITION BY entity, property ORDER BY coalesce(last_confirmed, first_seen, TIMESTAMPTZ '1970-01-01 00:00:00+00') DESC, id) - 1.0) / nullif(count(*) OVER (PARTITION BY entity, property) - 1, 0), 0)) END"""
_ABSOLUTE = "CASE WHEN coalesce(last_confirmed, first_seen) IS NULL THEN 0 ELSE 0.6 * power(0.5, greatest(epoch_us({AS_OF}) - epoch_us(coalesce(last_confirmed, first_seen)), 0) / 86400000000.0 / 14) END"
_NARROW = "status = 'active' AND coalesce(confidence, 0) >= 0.5 AND memory_type = 'decision'"


@R("SCO09_filtered_final", _with(_NARROW) + f" SELECT id, round(3.0 * f + 1.1 * v + b + 0.2 + {_RELATIVE} + {_ABSOLUTE}, 6) AS score FROM sc")
def _(s, d):
    p = parts(s, d, _NARROW)
    at = F.coalesce("last_confirmed", "first_seen", F.lit("1970-01-01 00:00:00").cast("timestamp"))
    slot = Window.partitionBy("entity", "property")
    place = F.row_number().over(slot.orderBy(at.desc(), "id")) - 1
    # rows without a slot don't meet in one window: they get a key of their own
    n = F.count(F.lit(1)).over(slot)
    inside = p.where("entity IS NOT NULL AND property IS NOT NULL").withColumn("relative", 0.8 * (1 - F.coalesce(F.try_divide(place, n - 1), F.lit(0.0))))
    rows = inside.unionByName(p.where("entity IS NULL OR property IS NULL").withColumn("relative", F.lit(0.0)))
    absolute = temporal.half_life(temporal.age_days(F.coalesce("last_confirmed", "first_seen"), as_of()), 14.0, 0.6)
    return rows.select("id", F.round(search.filtered_final_score(F.col("fts"), F.col("vector"), F.col("structured"), F.col("relative"), absolute), 6).alias("score"))


_FUSED = _with(_OPEN) + """, a AS (SELECT id, v FROM sc ORDER BY round(v, 9) DESC, id LIMIT 50), b AS (SELECT id, f FROM sc WHERE f > 0 ORDER BY round(f, 9) DESC, id LIMIT 50)"""


def _hits(p):
    """The 50 best by vector and the 50 best by full text, with both scores."""
    a = p.orderBy(F.desc(F.round("vector", 9)), "id").limit(50).select("id", "vector")
    b = p.where("fts > 0").orderBy(F.desc(F.round("fts", 9)), "id").limit(50).select("id", "fts")
    return a, b


@R("JON03_fused_hits", _FUSED + " SELECT id, text, round(0.6 * coalesce(v, 0) + 0.4 * coalesce(f, 0), 6) AS score FROM (SELECT coalesce(a.id, b.id) AS id, v, f FROM a FULL JOIN b ON a.id = b.id) JOIN (SELECT id, text FROM c) USING (id)")
def _(s, d):
    p = parts(s, d, _OPEN)
    a, b = _hits(p)
    z = lambda c: F.coalesce(c, F.lit(0.0))
    fused = a.join(b, "id", "full").select("id", F.round(0.6 * z("vector") + 0.4 * z("fts"), 6).alias("score"))
    return claims(s, d, "text").join(F.broadcast(fused), "id").select("id", "text", "score")  # at most 100


#: What each setting of the pipeline uses: vector hits, full-text hits, recency.
SETTINGS = {"full": (True, True, True), "no_temporal": (True, True, False), "vector_only": (True, False, False), "fts_only": (False, True, False)}
_SETTING_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS setting, id, round({'0.6 * coalesce(v, 0)' if v else '0'} + {'0.4 * coalesce(f, 0)' if f else '0'} + {'0.6 * r' if t else '0'}, 6) AS score FROM (SELECT coalesce(a.id, b.id) AS id, a.v, b.f FROM a FULL JOIN b ON a.id = b.id) JOIN (SELECT id, r FROM sc) USING (id) WHERE {' OR '.join([x for x, use in (('v IS NOT NULL', v), ('f IS NOT NULL', f)) if use])}"
    for n, (v, f, t) in SETTINGS.items()
)


@R("SCO10_settings", _FUSED + " " + _SETTING_SQL)
def _(s, d):
    """The fusion under each setting: a part that is switched off adds no hits and no score."""
    p = parts(s, d, _OPEN)
    a, b = _hits(p)
    z = lambda c: F.coalesce(c, F.lit(0.0))
    both = a.withColumnRenamed("vector", "v").join(b.withColumnRenamed("fts", "f"), "id", "full").join(p.select("id", "recency"), "id")
    out = None
    for name, (v, f, t) in SETTINGS.items():
        score = (0.6 * z("v") if v else F.lit(0.0)) + (0.4 * z("f") if f else F.lit(0.0)) + (0.6 * F.col("recency") if t else F.lit(0.0))
        kept = F.expr(" OR ".join([x for x, use in (("v IS NOT NULL", v), ("f IS NOT NULL", f)) if use]))
        one = both.where(kept).select(F.lit(name).alias("setting"), "id", F.round(score, 6).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


@R("TOP01_hybrid_search", _with(_OPEN) + f" SELECT id, score FROM (SELECT *, round({_FINAL}, 6) AS score FROM sc ORDER BY {_ORDER} LIMIT 20)")
def _(s, d):
    return hybrid(s, d)


@R("RPT36_hybrid_with_parts", _with(_OPEN) + f" SELECT id, score, round(f, 6) AS fts, round(v, 6) AS vector, round(b, 6) AS structured, round(r, 6) AS recency FROM (SELECT *, round({_FINAL}, 6) AS score FROM sc ORDER BY {_ORDER} LIMIT 20)")
def _(s, d):
    top = _ranked(parts(s, d, _OPEN), _OF()).limit(20)
    return top.select("id", "score", *[F.round(c, 6).alias(c) for c in ("fts", "vector", "structured", "recency")])


@R("RPT12_fts_of_sensitivities", _with("status = 'active' AND sensitivity IN ('public', 'restricted')") + " SELECT id, round(3.0 * f + b, 6) AS score FROM sc WHERE f > 0 ORDER BY score DESC, id LIMIT 30")
def _(s, d):
    p = parts(s, d, "status = 'active' AND sensitivity IN ('public', 'restricted')").where("fts > 0")
    return p.select("id", F.round(3.0 * F.col("fts") + F.col("structured"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(30)


@R("RPT11_search_for_agent", _with("status = 'active' AND sensitivity IN ('public', 'internal')") + f""",
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE kind = 'daily_note'), m AS (SELECT DISTINCT 'line:' || doc_id AS id, line, 0.3 * (CAST(contains(lower(line), 'snapshot') AS INT) + CAST(contains(lower(line), 'owner') AS INT)) AS score FROM l WHERE regexp_matches(line, '^(- |## |### )') AND NOT regexp_matches(lower(line), 'secret|password|token|restricted'))
SELECT * FROM (SELECT id, text, round({_FINAL}, 6) AS score FROM sc ORDER BY {_ORDER} LIMIT 20) UNION ALL SELECT id, line, round(score, 6) FROM m WHERE score > 0""")
def _(s, d):
    """What an agent may read: claims of its sensitivities by the final score, and note lines that don't look restricted; no rerank."""
    top = _ranked(parts(s, d, "status = 'active' AND sensitivity IN ('public', 'internal')"), _OF()).limit(20).select("id", "text", "score")
    lines = table(s, d, "documents").where("kind = 'daily_note'").select("doc_id", F.explode(F.split("text", "\n")).alias("text")).where(F.col("text").rlike("^(- |## |### )") & ~F.lower("text").rlike("secret|password|token|restricted"))
    hits = sum((F.contains(F.lower("text"), F.lit(t)).cast("int") for t in search.term_list(QUESTION)), F.lit(0))
    found = lines.select(F.concat(F.lit("line:"), F.col("doc_id").cast("string")).alias("id"), "text", F.round(0.3 * hits, 6).alias("score")).where("score > 0").distinct()
    return top.unionByName(found)


_RAW = f"(0.18 * (CAST(list_contains({_tok('text')}, 'snapshot') AS INT) + CAST(list_contains({_tok('text')}, 'owner') AS INT)))"
_RERANK = _with(_OPEN) + f""", t AS (SELECT id, score, raw, row_number() OVER (ORDER BY {_ORDER}) AS o FROM (SELECT *, round({_FINAL}, 6) AS score, {_RAW} AS raw FROM sc)),"""


def _rerank(s, d, head: int, blend: bool):
    rows = parts(s, d, _OPEN).withColumn("score", F.round(_OF(), 6)).withColumn("raw", 0.18 * sum((F.array_contains(retrieval.tokens(F.col("text")), t).cast("int") for t in search.term_list(QUESTION)), F.lit(0)))
    order = [F.desc("score"), F.desc_nulls_last("confidence"), F.desc_nulls_last("importance"), F.desc_nulls_last("last_confirmed"), F.asc("id")]
    kept = rows.select("id", "score", "raw", "confidence", "importance", "last_confirmed")
    return search.rerank(kept, order, ["id"], head, F.col("raw"), blend).select("id", "score", F.round("reranked", 6).alias("reranked"), "place")


@R("TOP02_rerank_head_and_tail", _RERANK + """
h AS (SELECT id, score, 0.35 * score + 1.25 / (1 + exp(-raw)) AS x, o FROM t WHERE o <= 12)
SELECT id, score, round(x, 6) AS reranked, row_number() OVER (ORDER BY x DESC, o) AS place FROM h UNION ALL SELECT id, score, NULL, NULL FROM t WHERE o > 12""")
def _(s, d):
    """The first 12 blended with their raw score; the tail keeps its score and follows in its order (no place)."""
    return _rerank(s, d, 12, True)


@R("TOP03_rerank_by_raw", _RERANK + """
h AS (SELECT id, score, raw AS x, o FROM t WHERE o <= 20)
SELECT id, score, round(x, 6) AS reranked, row_number() OVER (ORDER BY x DESC, o) AS place FROM h UNION ALL SELECT id, score, NULL, NULL FROM t WHERE o > 20""")
def _(s, d):
    """The first 20 by the raw score of their text, the overflow after them."""
    return _rerank(s, d, 20, False)


@R("TOP04_rerank_merged", _with(_OPEN) + f""",
code AS (SELECT id, concat_ws(chr(10), nullif(qualified_name, ''), nullif(signature, ''), nullif(docstring, '')) AS text FROM code_chunks WHERE id IS NOT NULL),
hit AS (SELECT 'memory' AS source, id, substr(text, 1, 1000) AS text, round({_FINAL}, 6) AS score FROM sc UNION ALL SELECT 'code', id, substr(text, 1, 1000), round(0.18 * (CAST(list_contains({_tok('text')}, 'snapshot') AS INT) + CAST(list_contains({_tok('text')}, 'owner') AS INT)), 6) FROM code),
t AS (SELECT source, id, score, {_RAW} AS raw, row_number() OVER (ORDER BY score DESC, source, id) AS o FROM hit), h AS (SELECT * FROM t WHERE o <= 20)
SELECT source, id, score, round(raw, 6) AS reranked, row_number() OVER (ORDER BY raw DESC, o) AS place FROM h UNION ALL SELECT source, id, score, NULL, NULL FROM t WHERE o > 20""")
def _(s, d):
    """Claims and code chunks in one list: the first 20 by the raw score of what describes them, the overflow after them."""
    raw = 0.18 * sum((F.array_contains(retrieval.tokens(F.col("text")), t).cast("int") for t in search.term_list(QUESTION)), F.lit(0))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    memory = parts(s, d, _OPEN).select(F.lit("memory").alias("source"), "id", F.substring("text", 1, 1000).alias("text"), F.round(_OF(), 6).alias("score"))
    code = table(s, d, "code_chunks").where("id IS NOT NULL").select(F.lit("code").alias("source"), "id", F.substring(F.concat_ws("\n", blank("qualified_name"), blank("signature"), blank("docstring")), 1, 1000).alias("text")).withColumn("score", F.round(raw, 6))
    rows = memory.unionByName(code).withColumn("raw", raw).drop("text")
    return search.rerank(rows, [F.desc("score"), F.asc("source"), F.asc("id")], ["source", "id"], 20, F.col("raw"), False).select("source", "id", "score", F.round("reranked", 6).alias("reranked"), "place")


@R("SCO30_parts_of_score", _with(_OPEN) + """ SELECT id, unnest(['fts', 'vector', 'structured', 'importance', 'recency']) AS component, unnest([round(f, 6), round(v, 6), round(b, 6), 0.2, round(r, 6)]) AS raw, unnest([3.0, 1.1, 1.0, 1.0, 0.6]) AS weight, unnest([round(3.0 * f, 6), round(1.1 * v, 6), round(b, 6), 0.2, round(0.6 * r, 6)]) AS weighted FROM sc""")
def _(s, d):
    p = parts(s, d, _OPEN).withColumn("importance_bonus", F.lit(0.2))
    one = lambda name, c, w: F.struct(F.lit(name).alias("component"), F.round(c, 6).alias("raw"), F.lit(w).alias("weight"), F.round(w * F.col(c), 6).alias("weighted"))
    every = F.array(one("fts", "fts", 3.0), one("vector", "vector", 1.1), one("structured", "structured", 1.0), one("importance", "importance_bonus", 1.0), one("recency", "recency", 0.6))
    return p.select("id", F.explode(every).alias("x")).select("id", "x.*")


@R("AGG29_session_scores", _with("status = 'active' AND source_session IS NOT NULL") + f""" SELECT source_session, n, score, rank() OVER (ORDER BY score DESC) AS place FROM (SELECT source_session, count(*) AS n, max(round({_FINAL}, 6)) AS score FROM sc GROUP BY source_session)""")
def _(s, d):
    """Sessions ranked by their best claim's final score; one row per session reaches the window."""
    p = parts(s, d, "status = 'active'").select("id", F.round(_OF(), 6).alias("score"))
    best = p.join(claims(s, d, "source_session").where("source_session IS NOT NULL"), "id").groupBy("source_session").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"))
    return best.withColumn("place", F.rank().over(Window.orderBy(F.desc("score"))))


_SINCE, _UNTIL = "2025-03-01 00:00:00", "2026-02-01 00:00:00"


@R("FLT03_epoch_bounds", f"SELECT id FROM {{CUR}} WHERE coalesce(last_confirmed, first_seen, created_at) IS NULL OR epoch(coalesce(last_confirmed, first_seen, created_at)) BETWEEN epoch(TIMESTAMPTZ '{_SINCE}+00') AND epoch(least(TIMESTAMPTZ '{_UNTIL}+00', {{AS_OF}}))")
def _(s, d):
    """since, and the earlier of until and as_of, as seconds; undated rows pass."""
    at = F.coalesce("last_confirmed", "first_seen", "created_at")
    low, high = F.lit(_SINCE).cast("timestamp"), F.least(F.lit(_UNTIL).cast("timestamp"), as_of())
    inside = (F.unix_micros(at) >= F.unix_micros(low)) & (F.unix_micros(at) <= F.unix_micros(high))
    return claims(s, d, "last_confirmed", "first_seen", "created_at").where(at.isNull() | inside).select("id")
