"""Queries on claims in free text, their classes, answers, compiler messages and evaluation of answers (FUN, WIN10, EVA)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamspark.functions import claims as says
from loamspark.functions import dates
from loamspark.operators import temporal
from loamspark.plans.common import AS_OF, Registry, as_of, claims
from loamspark.session import table

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _any(t: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, {_q(w)})" for w in words) + ")"


@R("FUN05_week_start", "SELECT id, strftime(date_trunc('week', coalesce(first_seen, created_at)), '%Y-%m-%d') AS week FROM {CUR} WHERE coalesce(first_seen, created_at) IS NOT NULL")
def _(s, d):
    at = F.coalesce("first_seen", "created_at")
    return claims(s, d, "first_seen", "created_at").where(at.isNotNull()).select("id", F.date_format(F.date_trunc("WEEK", at), "yyyy-MM-dd").alias("week"))


@R("FUN07_all_dates", " UNION ALL ".join(f"SELECT doc_id, {i} AS family, unnest(regexp_extract_all(text, {_q(p)}, 0, 'i')) AS found FROM documents WHERE text IS NOT NULL" for i, p in enumerate(says.DATE_PATTERNS)))
def _(s, d):
    t = table(s, d, "documents").where("text IS NOT NULL")

    def family(i, p):
        return F.transform(F.regexp_extract_all("text", F.lit(f"(?i){p}"), 0), lambda m: F.struct(F.lit(i).alias("family"), m.alias("found")))

    every = F.flatten(F.array(*[family(i, p) for i, p in enumerate(says.DATE_PATTERNS)]))
    return t.select("doc_id", F.explode(every).alias("x")).select("doc_id", "x.*")


@R("FUN10_task_types", "SELECT item_id, CASE WHEN greatest(a, r, p, c) = 0 THEN 'general' WHEN a = greatest(a, r, p, c) THEN 'assistant' WHEN r = greatest(a, r, p, c) THEN 'review' WHEN p = greatest(a, r, p, c) THEN 'planning' ELSE 'coding' END AS task FROM (SELECT item_id, "
+ ", ".join(f"len(regexp_extract_all(question || ' ' || text, '\\b({w})\\b', 0, 'i')) AS {k[0]}" for k, w in says.TASK_WORDS.items()) + " FROM eval_items WHERE question IS NOT NULL AND text IS NOT NULL)")
def _(s, d):
    q = table(s, d, "eval_items").where("question IS NOT NULL AND text IS NOT NULL")
    return q.select("item_id", says.task_type(F.concat_ws(" ", "question", "text")).alias("task"))


_CODE = r"function|class|method|import|module|def |return |variable|parameter|parse|compile|syntax|ast|bug|error|traceback|exception|\.py\b|\.cpp\b|\.h\b|\.ts\b|\.js\b|code|refactor|implement|api|endpoint|schema|migration"
_TIME = r"when|yesterday|today|last week|last month|ago|timeline|history|chronolog|sequence|before|after|\d{4}-\d{2}-\d{2}|january|february|march|april|may|june|july|august|september|october|november|december"
_MEMORY = "remember|decision|preference|lesson|rule|workflow|convention|standard|policy|agreement|what did|who said|why did|how do we"


@R("FUN09_query_types", f"""
SELECT item_id, CASE WHEN greatest(c, t, m) <= 0.08 THEN 'general' WHEN c = greatest(c, t, m) THEN 'code' WHEN t = greatest(c, t, m) THEN 'timeline' ELSE 'memory' END AS kind FROM (
SELECT item_id, len(regexp_extract_all(x, {_q(rf'\b({_CODE})\b')}, 0, 'i')) / n AS c, len(regexp_extract_all(x, {_q(rf'\b({_TIME})\b')}, 0, 'i')) / n AS t, len(regexp_extract_all(x, {_q(rf'\b({_MEMORY})\b')}, 0, 'i')) / n AS m FROM (
SELECT item_id, trim(question) AS x, greatest(len(regexp_extract_all(question, '[^ \\t\\r\\n]+')), 1) * 1.0 AS n FROM eval_items WHERE question IS NOT NULL))""")
def _(s, d):
    """The densest kind of word in a query; code before timeline before memory; general up to a share of .08."""
    x = F.trim("question")
    n = F.greatest(F.regexp_count(x, F.lit(r"\S+")), F.lit(1))
    share = lambda p: F.regexp_count(x, F.lit(rf"(?i)\b({p})\b")) / n
    q = table(s, d, "eval_items").where("question IS NOT NULL").select("item_id", share(_CODE).alias("c"), share(_TIME).alias("t"), share(_MEMORY).alias("m"))
    best = F.greatest("c", "t", "m")
    return q.select("item_id", F.when(best <= 0.08, "general").when(F.col("c") == best, "code").when(F.col("t") == best, "timeline").otherwise("memory").alias("kind"))


@R("FUN16_assistant_text", r"""
SELECT doc_id, x AS text FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '^ASSISTANT: ', 'ASSISTANT: <think>' || kind || '</think><final>', 'gm'), '(?s)<think>.*?</think>', '', 'g'), '</?final>', '', 'gi'), ' ' || chr(10) || chr(13) || chr(9)) AS x FROM documents WHERE kind = 'transcript' AND text IS NOT NULL) WHERE x <> '' AND NOT starts_with(x, 'think' || chr(10))""")
def _(s, d):
    """What assistants said: blocks of thought and the tags of final answers are dropped. The tags are put into the test texts."""
    t = table(s, d, "documents").where("kind = 'transcript' AND text IS NOT NULL")
    marked = F.regexp_replace("text", F.lit("(?m)^ASSISTANT: "), F.concat(F.lit("ASSISTANT: <think>"), F.col("kind"), F.lit("</think><final>")))
    x = F.trim(F.regexp_replace(F.regexp_replace(marked, "(?s)<think>.*?</think>", ""), "(?i)</?final>", ""), F.lit(" \n\r\t"))
    return t.select("doc_id", x.alias("text")).where((F.col("text") != "") & ~F.startswith("text", F.lit("think\n")))


_SEGMENTS = r"list_transform(string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^#{1,6}\s+', '', 'g'), '\*{1,3}([^*]+)\*{1,3}', '\1', 'g'), '(?m)^\s*[-*+]\s+', '', 'g'), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x, ' '))"


@R("FUN19_claim_segments", f"SELECT doc_id, x AS claim FROM (SELECT doc_id, unnest({_SEGMENTS}) AS x FROM documents WHERE kind = 'summary' AND text IS NOT NULL) WHERE length(x) BETWEEN 15 AND 500 AND NOT (" + " OR ".join(f"regexp_matches(x, {_q(p)})" for p in says.NOISE) + ")")
def _(s, d):
    return table(s, d, "documents").where("kind = 'summary' AND text IS NOT NULL").select("doc_id", F.explode(says.claim_segments(F.col("text"))).alias("claim"))


def _kinds_sql(t: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(t, w)} THEN '{k}'" for k, w in says.CLAIM_TYPES.items()) + " ELSE 'fact' END"


@R("FUN20_claim_classes", f"""
SELECT id, claim_type, CASE WHEN claim_type IN ('rule', 'decision', 'implementation_pattern', 'bug_history') THEN 'durable_eligible' WHEN claim_type = 'preference' THEN 'review_required' WHEN {_any('t', says.DURABLE_WORDS)} THEN 'durable_eligible' WHEN {_any('t', says.REVIEW_WORDS)} THEN 'review_required' ELSE 'candidate' END AS durability,
CASE WHEN {_any('t', says.CRITICAL_WORDS)} THEN 'critical' WHEN claim_type IN ('rule', 'decision') OR {_any('t', says.HIGH_WORDS)} THEN 'high' ELSE 'medium' END AS impact,
CASE source_agent WHEN 'main' THEN 'user_explicit' WHEN 'bench-runner' THEN 'system_tool_verified' WHEN 'coder' THEN 'assistant_inferred' ELSE 'unknown' END AS authority
FROM (SELECT id, source_agent, lower(text) AS t, {_kinds_sql('lower(text)')} AS claim_type FROM {{CUR}} WHERE text IS NOT NULL)""")
def _(s, d):
    """Claim type, durability, impact, and authority by role (here: main speaks for the user, bench-runner for tools, coder for the assistant)."""
    by = F.col("source_agent")
    authority = F.when(by == "main", "user_explicit").when(by == "bench-runner", "system_tool_verified").when(by == "coder", "assistant_inferred").otherwise("unknown")
    return claims(s, d, "text", "source_agent").where("text IS NOT NULL").select("id", *[c.alias(k) for k, c in says.claim_class(F.col("text")).items()], authority.alias("authority"))


_REASONS = f"""list_filter([CASE WHEN regexp_matches(x, {_q(says.DIRECTIVE)}) THEN 'prompt_directive' END, CASE WHEN regexp_matches(x, {_q(says.PAYLOAD)}) THEN 'embedded_payload' END, CASE WHEN regexp_matches(x, {_q(says.DIGEST)}) THEN 'opaque_digest' END], lambda r: r IS NOT NULL)"""


@R("FUN21_noise_reasons", f"SELECT doc_id, unnest({_REASONS}) AS reason FROM (SELECT doc_id, text AS x FROM documents WHERE text IS NOT NULL)")
def _(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(says.noise_reasons(F.col("text"))).alias("reason"))


@R("FUN22_candidate_reasons", f"""
SELECT id, array_to_string(list_concat(list_concat(list_filter([CASE WHEN t = '' THEN 'empty_claim_text' END, CASE WHEN {_any('t', says.REASONING_WORDS)} THEN 'contains_reasoning' END, CASE WHEN {_any('t', says.SPECULATION_WORDS)} THEN 'contains_speculation' END, CASE WHEN contains(t, '?') THEN 'question_not_durable' END], lambda r: r IS NOT NULL), {_REASONS}),
list_filter([CASE WHEN len(list_filter(regexp_split_to_array(t, '[ \\t\\r\\n]+'), lambda w: w <> '')) > 80 THEN 'not_atomic_enough' END, CASE WHEN source_agent IN ('coder', 'scout') THEN 'authority_not_explicit' END, CASE WHEN coalesce(context_scope_type, '') = '' THEN 'missing_scope_type' END], lambda r: r IS NOT NULL)), ',') AS reasons
FROM (SELECT id, source_agent, context_scope_type, coalesce(text, '') AS x, lower(trim(coalesce(text, ''), ' ')) AS t FROM {{CUR}})""")
def _(s, d):
    authority = F.when(F.col("source_agent").isin("coder", "scout"), "assistant_inferred").otherwise("user_explicit")
    return claims(s, d, "text", "source_agent", "context_scope_type").select("id", F.concat_ws(",", says.candidate_reasons(F.col("text"), authority, F.col("context_scope_type"))).alias("reasons"))


_NORM = r"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '\b(a|an|the)\b', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda w: w <> '')"
_F1 = "CASE WHEN len(p) > 0 AND len(g) > 0 THEN 2.0 * list_sum(list_transform(list_distinct(g), lambda t: least(len(list_filter(p, lambda w: w = t)), len(list_filter(g, lambda w: w = t))))) / (len(p) + len(g)) ELSE CAST(len(p) = len(g) AS INT) END"


@R("FUN23_answer_scores", f"""SELECT id, round({_F1}, 6) AS f1, array_to_string(p, ' ') = array_to_string(g, ' ') AS exact, contains(array_to_string(p, ' '), array_to_string(g, ' ')) AS holds FROM (SELECT id, {_NORM.format('text')} AS p, {_NORM.format('value')} AS g FROM {{CUR}})""")
def _(s, d):
    """Each claim's text as the answer to its value: multiset F1, exact match and containment of normalised answers."""
    p, g = says.normal_answer(F.col("text")), says.normal_answer(F.col("value"))
    flat = lambda x: F.array_join(x, " ")
    c = claims(s, d, "text", "value").select("id", p.alias("p"), g.alias("g"))
    return c.select("id", F.round(says.token_f1(F.col("p"), F.col("g")), 6).alias("f1"), (flat("p") == flat("g")).alias("exact"), F.contains(flat("p"), flat("g")).alias("holds"))


@R("FUN26_polarity", f"SELECT id, CASE WHEN {_any('t', says.NEGATIVE_CUES)} THEN 'negative' WHEN {_any('t', says.POSITIVE_CUES)} THEN 'positive' END AS polarity FROM (SELECT id, lower(trim(text, ' ')) AS t FROM {{CUR}} WHERE text IS NOT NULL)")
def _(s, d):
    return claims(s, d, "text").where("text IS NOT NULL").select("id", says.polarity(F.col("text")).alias("polarity"))


_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE kind = 'build_log' AND text IS NOT NULL)"
_MESSAGES = f"""(SELECT doc_id, pos, {', '.join(f"CASE WHEN regexp_matches(l, {_q(says.LINKER_LINE)}) AND NOT ({' OR '.join(f'regexp_matches(l, {_q(p)})' for p in says.BUILD_LINES)}) THEN {link} " + ' '.join(f"WHEN regexp_matches(l, {_q(p)}) THEN {wrap(f'regexp_extract(l, {_q(p)}, {i})')}" for p in says.BUILD_LINES) + f" END AS {name}" for i, name, link, wrap in [
    (1, 'file', "'<linker>'", lambda x: x), (2, 'line', '0', lambda x: f'TRY_CAST({x} AS INT)'), (3, 'col', 'NULL', lambda x: f'TRY_CAST({x} AS INT)'), (4, 'severity', f"regexp_extract(l, {_q(says.LINKER_LINE)}, 1)", lambda x: x), (5, 'message', f"trim(regexp_extract(l, {_q(says.LINKER_LINE)}, 2), ' ')", lambda x: f"trim({x}, ' ')")])}
 FROM (SELECT doc_id, pos, rtrim(raw, ' ') AS l FROM {_LINES}) WHERE NOT regexp_matches(l, {_q(says.BUILD_NOISE)}))"""


def messages(s, d):
    """(doc_id, pos, file, line, col, severity, message) of compiler and linker lines in build logs."""
    lines = table(s, d, "documents").where("kind = 'build_log' AND text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return lines.withColumn("m", says.build_message(F.col("raw"))).where("m IS NOT NULL").select("doc_id", "pos", "m.*")


@R("FUN29_build_messages", f"SELECT doc_id, pos, file, line, col, severity, message FROM {_MESSAGES} WHERE file IS NOT NULL")
def _(s, d):
    return messages(s, d)


def _category_sql(m: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({m}, {_q('(?i)' + p)}) THEN '{k}'" for k, p in says.ERROR_PATTERNS) + " ELSE 'unknown' END"


_HINTS = "(VALUES " + ", ".join(f"({_q(k)}, {_q(v)})" for k, v in says.FIX_HINTS.items()) + ") AS h(category, hint)"


@R("FUN30_error_categories", f"SELECT doc_id, pos, category, hint FROM (SELECT doc_id, pos, {_category_sql('message')} AS category FROM {_MESSAGES} WHERE file IS NOT NULL) JOIN {_HINTS} USING (category)")
def _(s, d):
    hint = F.create_map(*[F.lit(x) for kv in says.FIX_HINTS.items() for x in kv])
    return messages(s, d).withColumn("category", says.error_category(F.col("message"))).select("doc_id", "pos", "category", hint[F.col("category")].alias("hint"))


_CONTEXT = r"(?i)(in instantiation of|required from|instantiated from)"


@R("WIN10_error_groups", f"""
WITH m AS (SELECT doc_id, pos, file || ':' || line AS loc, severity, {_category_sql('message')} AS category, CASE WHEN severity = 'note' AND regexp_matches(message, {_q(_CONTEXT)}) THEN 'template_error' WHEN severity = 'note' AND regexp_matches(message, '(?i)expanded from macro') THEN 'macro_expansion' END AS shown FROM {_MESSAGES} WHERE file IS NOT NULL),
f AS (SELECT *, severity IN ('error', 'fatal error') OR (severity = 'warning' AND last_value(CASE WHEN severity <> 'note' THEN loc END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS DISTINCT FROM loc) AS starts FROM m),
g AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM f)
SELECT doc_id, grp, min(pos) AS root_pos, min_by(severity, pos) AS severity, coalesce(max_by(shown, pos) FILTER (shown IS NOT NULL), min_by(category, pos)) AS category, count(*) - 1 AS related FROM g WHERE grp > 0 GROUP BY ALL""")
def _(s, d):
    """Groups of messages: an error begins one, and a warning elsewhere than the last error or warning; notes and other
    warnings attach. A note that shows a template or macro gives the group that category. A log's lines are one text."""
    m = messages(s, d).withColumn("loc", F.concat_ws(":", "file", F.col("line").cast("string"))).withColumn("category", says.error_category(F.col("message")))
    note = F.col("severity") == "note"
    shown = F.when(note & F.col("message").rlike(_CONTEXT), "template_error").when(note & F.col("message").rlike("(?i)expanded from macro"), "macro_expansion")
    w = Window.partitionBy("doc_id").orderBy("pos")
    before = F.last(F.when(~note, F.col("loc")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.col("severity").isin("error", "fatal error") | ((F.col("severity") == "warning") & ~before.eqNullSafe(F.col("loc")))
    g = m.withColumn("shown", shown).withColumn("starts", starts.cast("int")).withColumn("grp", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("grp > 0")
    last = F.max_by("shown", F.when(F.col("shown").isNotNull(), F.col("pos")))
    return g.groupBy("doc_id", "grp").agg(F.min("pos").alias("root_pos"), F.min_by("severity", "pos").alias("severity"), F.coalesce(last, F.min_by("category", "pos")).alias("category"), (F.count(F.lit(1)) - 1).alias("related"))


_REL = "(SELECT id AS item, entity AS query, CASE memory_type WHEN 'decision' THEN 3 WHEN 'fact' THEN 2 WHEN 'constraint' THEN 1 ELSE 0 END AS rel, row_number() OVER (PARTITION BY entity ORDER BY last_confirmed DESC NULLS LAST, id) AS rank FROM {CUR} WHERE entity IS NOT NULL AND entity <> 'general')"


@R("EVA02_ndcg_both_gains", f"""
WITH r AS {_REL}, i AS (SELECT query, rel, row_number() OVER (PARTITION BY query ORDER BY rel DESC, item) AS rank FROM r),
dcg AS (SELECT query, sum(rel / log2(rank + 1.0)) AS l, sum((power(2, rel) - 1) / log2(rank + 1.0)) AS e FROM r WHERE rank <= 10 GROUP BY query), best AS (SELECT query, sum(rel / log2(rank + 1.0)) AS l, sum((power(2, rel) - 1) / log2(rank + 1.0)) AS e FROM i WHERE rank <= 10 GROUP BY query)
SELECT query, round(coalesce(dcg.l / nullif(best.l, 0), 0), 6) AS linear, round(coalesce(dcg.e / nullif(best.e, 0), 0), 6) AS exponential FROM dcg JOIN best USING (query)""")
def _(s, d):
    """nDCG at 10 with gains rel and 2 ** rel - 1; entities are the queries, newest first is the ranking; only 10 rows of a query are ranked twice."""
    rel = F.when(F.col("memory_type") == "decision", 3).when(F.col("memory_type") == "fact", 2).when(F.col("memory_type") == "constraint", 1).otherwise(0)
    c = claims(s, d, "entity", "memory_type", "last_confirmed").where("entity IS NOT NULL AND entity <> 'general'").select("id", F.col("entity").alias("query"), rel.alias("rel"), "last_confirmed")

    def gains(order):
        top = c.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where("rank <= 10")
        discount = F.log2(F.col("rank") + 1.0)
        return top.groupBy("query").agg(F.sum(F.col("rel") / discount).alias("l"), F.sum((F.pow(F.lit(2.0), "rel") - 1) / discount).alias("e"))

    got, best = gains([F.desc_nulls_last("last_confirmed"), F.asc("id")]), gains([F.desc("rel"), F.asc("id")]).select("query", F.col("l").alias("bl"), F.col("e").alias("be"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return got.join(best, "query").select("query", ratio("l", "bl").alias("linear"), ratio("e", "be").alias("exponential"))


_STOPS = "the a an is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by from that this it its and or but not no if so as than".split()


@R("EVA12_nugget_recall", f"""
SELECT id, len(ns) = 0 OR len(list_filter(ns, lambda t: list_contains(held, t))) * 1.0 / len(ns) > 0.5 AS found FROM (
SELECT id, list_filter(regexp_extract_all(lower(coalesce(value, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 2 AND NOT list_contains([{', '.join(_q(w) for w in _STOPS)}], t)) AS ns, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS held FROM {{CUR}} WHERE text IS NOT NULL)""")
def _(s, d):
    """Whether more than half of a nugget's tokens (the value's; three letters or more, no stop words) occur in the retrieved text; an empty nugget is found."""
    word = F.lit(r"[\p{L}\p{N}_]+")
    ns = F.filter(F.regexp_extract_all(F.lower(F.coalesce("value", F.lit(""))), word, 0), lambda t: (F.length(t) > 2) & ~t.isin(*_STOPS))
    c = claims(s, d, "text", "value").where("text IS NOT NULL").select("id", ns.alias("ns"), F.regexp_extract_all(F.lower("text"), word, 0).alias("held"))
    hits = F.size(F.filter("ns", lambda t: F.array_contains("held", t)))
    return c.select("id", ((F.size("ns") == 0) | (hits / F.size("ns") > 0.5)).alias("found"))


#: Each slot is a question; its active claims, newest first, are what was retrieved; up to ten count.
_RETRIEVED = """r AS (SELECT entity, property, id, lower(coalesce(text, '') || ' ' || coalesce(value, '')) AS said, lower(value) AS answer, source_agent, row_number() OVER (PARTITION BY entity, property ORDER BY last_confirmed DESC NULLS LAST, id) AS rank FROM {CUR} WHERE status = 'active' AND entity IS NOT NULL AND property IS NOT NULL AND entity <> 'general'),
want AS (SELECT entity, property, max_by(lower(value), (coalesce(epoch_us(first_seen), 0), id)) AS latest, min_by(lower(value), (coalesce(epoch_us(first_seen), 0), id)) AS earliest FROM {CUR} WHERE entity IS NOT NULL AND property IS NOT NULL AND entity <> 'general' AND trim(coalesce(value, ''), ' ') <> '' GROUP BY ALL),
top AS (SELECT entity, property, string_agg(said, ' ' ORDER BY rank) AS every, min_by(said, rank) AS first, string_agg(CASE WHEN source_agent = 'main' THEN said END, ' ' ORDER BY rank) AS own FROM r WHERE rank <= 10 GROUP BY ALL)"""


def _retrieved(s, d):
    """(entity, property, every, first, own, latest, earliest): at most ten claims of a slot as text, and the slot's first and last value."""
    base = claims(s, d, "entity", "property", "value", "text", "status", "source_agent", "last_confirmed", "first_seen").where("entity IS NOT NULL AND property IS NOT NULL AND entity <> 'general'")
    said = F.lower(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("value", F.lit(""))))
    w = Window.partitionBy("entity", "property").orderBy(F.desc_nulls_last("last_confirmed"), "id")
    ten = base.where("status = 'active'").select("entity", "property", "id", "source_agent", "last_confirmed", said.alias("said")).withColumn("rank", F.row_number().over(w)).where("rank <= 10")
    own = F.when(F.col("source_agent") == "main", F.struct("rank", "said"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["said"]), " ")
    top = ten.groupBy("entity", "property").agg(joined(F.struct("rank", "said")).alias("every"), F.min_by("said", "rank").alias("first"), joined(own).alias("own"))
    order = F.struct(F.coalesce(F.unix_micros("first_seen"), F.lit(0)), "id")
    want = base.where("trim(coalesce(value, '')) <> ''").groupBy("entity", "property").agg(F.max_by(F.lower("value"), order).alias("latest"), F.min_by(F.lower("value"), order).alias("earliest"))
    return top.join(want, ["entity", "property"])


@R("EVA14_crud_correct", f"""WITH {_RETRIEVED} SELECT entity, property, contains(every, latest) AS found, earliest <> latest AND contains(coalesce(nullif(own, ''), every), earliest) AS violated, contains(every, latest) AND NOT (earliest <> latest AND contains(coalesce(nullif(own, ''), every), earliest)) AS correct FROM top JOIN want USING (entity, property)""")
def _(s, d):
    """The latest value should be found, the first one (deleted since) should not: that counts on the run's own rows (main's), or all if it has none."""
    r = _retrieved(s, d)
    mine = F.coalesce(F.nullif("own", F.lit("")), F.col("every"))
    violated = (F.col("earliest") != F.col("latest")) & F.contains(mine, F.col("earliest"))
    found = F.contains("every", F.col("latest"))
    return r.select("entity", "property", found.alias("found"), violated.alias("violated"), (found & ~violated).alias("correct"))


@R("EVA15_contradictions_resolved", f"""WITH {_RETRIEVED} SELECT entity, property, contains(first, latest) AS in_top, contains(first, earliest) AND NOT contains(first, latest) AS contradicted, contains(first, latest) AS resolved FROM top JOIN want USING (entity, property) WHERE earliest <> latest""")
def _(s, d):
    """The latest value stands in the first result, and the contradicted first value doesn't stand there alone."""
    r = _retrieved(s, d).where("earliest <> latest")
    in_top = F.contains("first", F.col("latest"))
    alone = F.contains("first", F.col("earliest")) & ~in_top
    return r.select("entity", "property", in_top.alias("in_top"), alone.alias("contradicted"), (in_top & ~alone).alias("resolved"))


@R("EVA16_temporal_accuracy", f"""WITH {_RETRIEVED}, q AS (SELECT 'latest' AS hint, contains(first, latest) AS ok FROM top JOIN want USING (entity, property) UNION ALL SELECT 'earliest', contains(every, earliest) FROM top JOIN want USING (entity, property)) SELECT hint, count(*) AS n, round(avg(CAST(ok AS INT)), 6) AS accuracy FROM q GROUP BY hint""")
def _(s, d):
    """Accuracy by hint: "latest" is right only in the first result, "earliest" anywhere among them."""
    asked = F.array(F.struct(F.lit("latest").alias("hint"), F.contains("first", F.col("latest")).alias("ok")), F.struct(F.lit("earliest").alias("hint"), F.contains("every", F.col("earliest")).alias("ok")))
    return _retrieved(s, d).select(F.explode(asked).alias("q")).groupBy("q.hint").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("q.ok").cast("int")), 6).alias("accuracy"))


_QUESTIONS = {"reference": "what changed on 2025-06-03", "bare": "when was the latest one", "plain": "pipeline owner"}
_LOG = "CASE WHEN at_ts IS NULL THEN 0 ELSE {0} END"


@R("SCO19_temporal_boost", """
WITH a AS (SELECT id, first_seen AS at_ts, greatest(epoch_us({AS_OF}) - epoch_us(first_seen), 0) / 86400000000.0 AS age FROM {CUR})
SELECT id, 'reference' AS question, CASE WHEN at_ts BETWEEN TIMESTAMPTZ '2025-06-03 00:00:00+00' AND TIMESTAMPTZ '2025-06-04 00:00:00+00' THEN 0.12 ELSE 0.0 END AS boost FROM a
UNION ALL SELECT id, 'bare', 0.0 FROM a
UNION ALL SELECT id, 'plain', round(CASE WHEN at_ts IS NULL THEN 0.0 WHEN age <= 1 THEN 0.10 ELSE least(greatest(0.10 / (1 + log2(1 + age / 14)) - CASE WHEN age > 60 THEN 0.08 * least((age - 60) / 180, 1) ELSE 0 END, -0.08), 0.10) END, 6) FROM a""")
def _(s, d):
    """The modifier of each claim: a match with the question's time, none for a question of time without one, else recency."""
    from datetime import datetime

    now = datetime.fromisoformat(AS_OF)
    c = claims(s, d, "first_seen")
    age = temporal.age_days(F.col("first_seen"), as_of())
    stale = F.when(age > 60, 0.08 * F.least((age - 60) / 180, F.lit(1.0))).otherwise(0.0)
    recency = F.when(F.col("first_seen").isNull(), 0.0).when(age <= 1, 0.10).otherwise(F.least(F.greatest(0.10 / (1 + F.log2(1 + age / 14)) - stale, F.lit(-0.08)), F.lit(0.10)))
    out = None
    for name, text in _QUESTIONS.items():
        temporal_words = s.range(1).select(dates.is_temporal(F.lit(text))).first()[0] or dates.time_reference(text, now) is not None
        found = dates.time_reference(text, now)
        if not temporal_words:
            boost = F.round(recency, 6)
        elif found is None:
            boost = F.lit(0.0)
        else:
            lo, hi = (F.lit(x.isoformat(sep=" ")).cast("timestamp") for x in found)
            boost = F.when(F.col("first_seen").between(lo, hi), 0.12).otherwise(0.0)
        one = c.select("id", F.lit(name).alias("question"), boost.alias("boost"))
        out = one if out is None else out.unionByName(one)
    return out
