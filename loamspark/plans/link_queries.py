"""Queries on links between claims and code: disputes, opposites, similar texts, nearest chunks, the code graph, sinks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from loamspark.operators import graph, joins, retrieval, search, temporal
from loamspark.plans.common import Registry, as_of, claims
from loamspark.plans.search_queries import _tok
from loamspark.session import materialize, table

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL

# Words and their opposites.
OPPOSITES = [("use ", "avoid "), ("requires ", "does not require "), ("enabled", "disabled"), ("available", "unavailable"), ("supported", "not supported"), ("should", "should not"), ("must", "must not"), ("always", "never"), ("true", "false"), ("yes", "no"), ("can", "cannot"), ("allowed", "not allowed"), ("recommended", "not recommended"), ("deprecated", "active"), ("removed", "added")]
LIKE_OPPOSITES = [("use ", "avoid "), ("requires ", "does not require "), ("enabled", "disabled"), ("available", "unavailable"), ("supported", "not supported"), ("should", "should not"), ("must", "must not")]
AGENT_ACCESS = {"coder": ["public", "internal"], "review": ["public", "internal"], "art": ["public"], "default": ["public"], "security": ["public", "internal", "restricted"], "admin": ["public", "internal", "restricted"]}
# End of fixed values.


@R("JON05_disputed_rows", """
WITH c AS (SELECT id, entity, property, source_agent, value FROM {CUR} WHERE status = 'active' AND entity IS NOT NULL AND property IS NOT NULL)
SELECT a.id, count(*) AS links FROM c a JOIN c b ON a.entity = b.entity AND a.property = b.property AND a.source_agent IS DISTINCT FROM b.source_agent AND a.value IS DISTINCT FROM b.value GROUP BY a.id""")
def _(s, d):
    c = claims(s, d, "entity", "property", "source_agent", "value", "status").where("status = 'active'")
    return joins.disputed(c, ["entity", "property"], "source_agent", "value", "id")


def _opposed(a: str, b: str, pairs) -> str:
    return "(" + " OR ".join(f"(contains({a}, '{x}') AND contains({b}, '{y}')) OR (contains({a}, '{y}') AND contains({b}, '{x}'))" for x, y in pairs) + ")"


@R("JON07_opposite_pairs", f"""
WITH c AS (SELECT id, entity, lower(text) AS t FROM {{CUR}} WHERE status IN ('active', 'candidate') AND coalesce(text, '') <> '' ORDER BY updated_at DESC, id LIMIT 500)
SELECT a.id AS id_a, b.id AS id_b, 0.6 AS confidence FROM c a JOIN c b ON a.entity = b.entity AND a.entity <> '' AND a.id < b.id AND {_opposed('a.t', 'b.t', OPPOSITES)}""")
def _(s, d):
    """Pairs with opposite words within an entity among the newest 500 claims, which is the detector's window."""
    c = claims(s, d, "entity", "text", "status", "updated_at").where("status IN ('active', 'candidate') AND coalesce(text, '') <> ''").orderBy(F.desc("updated_at"), "id").limit(500).select("id", "entity", F.lower("text").alias("t")).where("entity <> ''")
    a, b = c.alias("a"), c.alias("b")
    has = lambda side, w: F.contains(F.col(f"{side}.t"), F.lit(w))
    opposed = F.lit(False)
    for x, y in OPPOSITES:
        opposed = opposed | (has("a", x) & has("b", y)) | (has("a", y) & has("b", x))
    return a.join(b, (F.col("a.entity") == F.col("b.entity")) & (F.col("a.id") < F.col("b.id"))).where(opposed).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.lit(0.6).alias("confidence"))


@R("JON08_opposite_links", f"""
WITH c AS (SELECT id, entity, lower(text) AS t FROM {{CUR}} WHERE status = 'active' AND entity <> 'general' AND text IS NOT NULL)
SELECT a.id, count(*) AS links FROM c a JOIN c b ON a.entity = b.entity AND a.id <> b.id AND {_opposed('a.t', 'b.t', LIKE_OPPOSITES)} GROUP BY a.id""")
def _(s, d):
    c = claims(s, d, "entity", "text", "status").where("status = 'active' AND entity <> 'general'")
    return joins.opposite_links(c, "id", "entity", "text", LIKE_OPPOSITES)


_GRAMS = r"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@R("JON06_similar_texts", f"""
WITH c AS (SELECT id, entity, value, {_GRAMS} AS g FROM {{CUR}} WHERE status IN ('active', 'candidate') AND entity IS NOT NULL AND text IS NOT NULL)
SELECT a.id, count(*) AS links FROM c a JOIN c b ON a.entity = b.entity AND a.id <> b.id AND a.value IS DISTINCT FROM b.value AND len(a.g) > 0 AND len(b.g) > 0
 AND len(list_intersect(a.g, b.g)) * 100 > (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) * 85 GROUP BY a.id""")
def _(s, d):
    """Claims of an entity with similar texts (trigrams above .85) but other values: one row per claim with the number of its links."""
    c = claims(s, d, "entity", "text", "value", "status").where("status IN ('active', 'candidate')")
    return joins.similar_texts(c, "id", "entity", "text", "value", 85)


_CHUNK_TEXT = "concat_ws(' ', coalesce(qualified_name, ''), coalesce(signature, ''), coalesce(docstring, ''), coalesce(body, ''))"


def _vec_sql(table_: str, key: str, text: str) -> str:
    return f"(SELECT {key} AS k, h % 64 AS p, sum(CASE WHEN s < 8 THEN 1.0 ELSE -1.0 END) AS x FROM (SELECT {key}, CAST('0x' || substr(md5(t), 1, 7) AS BIGINT) AS h, CAST('0x' || substr(md5(t), 9, 1) AS BIGINT) AS s FROM (SELECT {key}, unnest({_tok(text)}) AS t FROM {table_})) GROUP BY ALL)"


@R("JON09_nearest_chunks", f"""
WITH q AS (SELECT id, text FROM {{CUR}} WHERE text IS NOT NULL AND CAST('0x' || substr(md5(id), 1, 6) AS BIGINT) % 50 = 0), c AS (SELECT id, {_CHUNK_TEXT} AS text FROM code_chunks WHERE id IS NOT NULL),
a AS {_vec_sql('q', 'id', 'text')}, b AS {_vec_sql('c', 'id', 'text')}, na AS (SELECT k, sqrt(sum(x * x)) AS n FROM a GROUP BY k), nb AS (SELECT k, sqrt(sum(x * x)) AS n FROM b GROUP BY k),
d AS (SELECT a.k AS id, b.k AS chunk_id, sum(a.x * b.x) AS dot FROM a JOIN b USING (p) GROUP BY ALL), r AS (SELECT d.id, chunk_id, round(dot / (na.n * nb.n), 6) AS similarity FROM d JOIN na ON d.id = na.k JOIN nb ON d.chunk_id = nb.k WHERE na.n > 0 AND nb.n > 0)
SELECT id, chunk_id, similarity FROM r WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, chunk_id) <= 3""")
def _(s, d):
    """The three nearest chunks of every 50th claim (by its hash), of at least NEAR similarity.

    Both sides are encoded by hashed tokens, whose similarities are lower than a sentence encoder's; NEAR is .3 here. The
    claims asked for are the stated query set: they go to the chunks in blocks, and each batch sends on three per claim.
    """
    asked = claims(s, d, "text").where("text IS NOT NULL").where((F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("long") % 50) == 0)
    chunks = table(s, d, "code_chunks").where("id IS NOT NULL").select("id", F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("qualified_name", "signature", "docstring", "body")]).alias("text"))
    return nearest_texts(asked, chunks, 3, 0.3)


def nearest_texts(asked, rows, k: int, least: float, block: int = 4096):
    """(id, chunk_id, similarity): the k rows nearest to each asked text, of at least `least`; asked texts go in blocks."""
    spark = rows.sparkSession
    asked = materialize(asked.select("id", retrieval.tokens(F.col("text")).alias("ts")), "asked")
    blocks = max(1, -(-asked.count() // block))
    held = rows.select("id", retrieval.tokens(F.col("text")).alias("ts"))

    def unit(x):
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.where(n > 0, x / np.where(n > 0, n, 1), 0.0)

    found = None
    for i in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect()  # about `block` rows
        if not some:
            continue
        shared = spark.sparkContext.broadcast(([r.id for r in some], unit(np.array([search._cells(r.ts, {}) for r in some]))))

        def run(batches, shared=shared):
            ids, q = shared.value
            seen: dict = {}
            for b in batches:
                if not b.num_rows:
                    continue
                x = unit(np.array([search._cells(ts, seen) for ts in b["ts"].to_pylist()]))
                sims = np.round(q @ x.T, 6)
                names = np.array(b["id"].to_pylist(), str)
                row, col = np.nonzero(sims >= np.maximum(np.partition(sims, max(0, sims.shape[1] - k), axis=1)[:, max(0, sims.shape[1] - k)], least)[:, None])
                yield pa.record_batch([pa.array([ids[r] for r in row], pa.string()), pa.array(names[col], pa.string()), pa.array(sims[row, col], pa.float64())], ["id", "chunk_id", "similarity"])

        part = held.mapInArrow(run, "id string, chunk_id string, similarity double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "id string, chunk_id string, similarity double")
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "chunk_id")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


_CLASS = "CASE WHEN n LIKE '%security%' OR n LIKE '%secops%' THEN 'security' WHEN n LIKE '%audit%' OR n LIKE '%admin%' THEN 'admin' WHEN regexp_matches(n, 'builder|coder|dev|engineer|tester|implementer|programmer') THEN 'coder' WHEN regexp_matches(n, 'review|reviewer|critic') THEN 'review' WHEN regexp_matches(n, 'artist|art|design|concept|visual') THEN 'art' ELSE 'default' END"


@R("FLT06_readable_by_agent", f"""
WITH a AS (SELECT DISTINCT source_agent AS agent, lower(trim(source_agent, ' ')) AS n FROM memory_items WHERE source_agent IS NOT NULL),
k AS (SELECT agent, CASE WHEN agent = 'main' OR {_CLASS} IN ('security', 'admin') THEN ['public', 'internal', 'restricted'] WHEN {_CLASS} IN ('coder', 'review') THEN ['public', 'internal'] ELSE ['public'] END AS may FROM a)
SELECT agent, sensitivity, count(*) AS n FROM {{CUR}} m JOIN k ON list_contains(may, sensitivity) GROUP BY ALL""")
def _(s, d):
    """What each agent may read, by sensitivity: its name gives its class, the class its sensitivities; main reads all."""
    name = F.lower(F.trim("agent"))
    kind = F.when(name.rlike("security|secops"), "security").when(name.rlike("audit|admin"), "admin").when(name.rlike("builder|coder|dev|engineer|tester|implementer|programmer"), "coder").when(name.rlike("review|reviewer|critic"), "review").when(name.rlike("artist|art|design|concept|visual"), "art").otherwise("default")
    policy = F.create_map(*[x for k, v in AGENT_ACCESS.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    agents = table(s, d, "memory_items").where("source_agent IS NOT NULL").select(F.col("source_agent").alias("agent")).distinct()
    may = agents.select("agent", F.explode(F.when(F.col("agent") == "main", F.array(*[F.lit(i) for i in AGENT_ACCESS["admin"]])).otherwise(policy[kind])).alias("sensitivity"))
    counts = claims(s, d, "sensitivity").groupBy("sensitivity").agg(F.count(F.lit(1)).alias("n"))
    return may.join(counts, "sensitivity").select("agent", "sensitivity", "n")


_LAYER = "CASE WHEN scope IN ('global', 'stable') THEN 'canonical' WHEN scope LIKE 'project:%' THEN 'project' WHEN scope = 'session' THEN 'ephemeral' WHEN scope IS NULL THEN 'private' ELSE 'user' END"


@R("FLT07_visible_layers", f"SELECT id, layer FROM (SELECT id, project_id, source_agent, {_LAYER} AS layer FROM {{CUR}}) WHERE layer IN ('canonical', 'user') OR (layer = 'project' AND (project_id = 'harbor' OR project_id IS NULL)) OR (layer IN ('private', 'ephemeral') AND source_agent = 'scout')")
def _(s, d):
    """What the agent scout sees in project harbor: canonical and user layers, the project's, its own private and ephemeral ones."""
    layer = F.when(F.col("scope").isin("global", "stable"), "canonical").when(F.startswith("scope", F.lit("project:")), "project").when(F.col("scope") == "session", "ephemeral").when(F.col("scope").isNull(), "private").otherwise("user")
    c = claims(s, d, "scope", "project_id", "source_agent").withColumn("layer", layer)
    return c.where("layer IN ('canonical', 'user') OR (layer = 'project' AND (project_id = 'harbor' OR project_id IS NULL)) OR (layer IN ('private', 'ephemeral') AND source_agent = 'scout')").select("id", "layer")


@R("SNK06_uuid5_points", """
SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST('0x' || substr(h, 17, 1) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
FROM (SELECT id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('memory:' || id)) AS h FROM {CUR})""")
def _(s, d):
    """Name-based UUIDs (version 5, URL namespace) of the claims' ids."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(F.concat(F.lit("memory:"), F.col("id")), "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring("h", 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    point = F.concat(F.substring("h", 1, 8), F.lit("-"), F.substring("h", 9, 4), F.lit("-5"), F.substring("h", 14, 3), F.lit("-"), variant, F.substring("h", 18, 3), F.lit("-"), F.substring("h", 21, 12))
    return claims(s, d, "status").select("id", h.alias("h")).select("id", point.alias("point_id"))


@R("SNK11_append_episodes", """
SELECT 'ep-' || substr(sha1(concat_ws('|', CAST(doc_id AS VARCHAR), coalesce(source_agent, ''), coalesce(strftime(captured_at, '%Y-%m-%d'), ''))), 1, 16) AS episode_id, doc_id, source_agent, substr(text, 1, 200) AS summary FROM documents WHERE kind = 'handoff' AND text IS NOT NULL""")
def _(s, d):
    """Episodes of handoffs, appended and never updated: writing the second half after the first leaves the first as it was."""
    from loamspark.session import scratch

    t = table(s, d, "documents").where("kind = 'handoff' AND text IS NOT NULL")
    eid = F.concat(F.lit("ep-"), F.substring(F.sha1(F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("source_agent", F.lit("")), F.coalesce(F.date_format("captured_at", "yyyy-MM-dd"), F.lit("")))), 1, 16))
    rows = t.select(eid.alias("episode_id"), "doc_id", "source_agent", F.substring("text", 1, 200).alias("summary"))
    path = scratch(s, "episodes")
    for half in (0, 1):
        rows.where(F.pmod("doc_id", F.lit(2)) == half).write.mode("append").parquet(path)
    return s.read.schema(rows.schema).parquet(path)


@R("SNK12_delete_and_prune", """
SELECT id, discarded_at FROM memory_discarded WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM memory_items WHERE id IS NOT NULL) AND (discarded_at IS NULL OR discarded_at >= {AS_OF} - INTERVAL 180 DAY)""")
def _(s, d):
    """The queue after its promoted ids are deleted and dated rows of more than 180 days are pruned."""
    q = table(s, d, "memory_discarded").where("id IS NOT NULL").select("id", "discarded_at")
    return q.join(table(s, d, "memory_items").select("id"), "id", "left_anti").where(F.col("discarded_at").isNull() | (F.col("discarded_at") >= as_of() - F.expr("INTERVAL 180 DAYS")))


@R("SNK13_moves_both_ways", """
SELECT id, CASE WHEN status = 'candidate' AND confidence >= 0.8 THEN 'active' WHEN status = 'active' AND confidence < 0.3 THEN 'candidate' ELSE status END AS status,
CASE WHEN status = 'candidate' AND confidence >= 0.8 THEN 'promoted' WHEN status = 'active' AND confidence < 0.3 THEN 'demoted' ELSE 'kept' END AS moved FROM {CUR}""")
def _(s, d):
    """One pass gives the store after moves in both directions, and what moved: promoted candidates, demoted active rows."""
    up, down = "status = 'candidate' AND confidence >= 0.8", "status = 'active' AND confidence < 0.3"
    moved = F.when(F.expr(up), "promoted").when(F.expr(down), "demoted").otherwise("kept")
    c = claims(s, d, "status", "confidence").withColumn("moved", moved)
    return c.select("id", F.when(F.col("moved") == "promoted", "active").when(F.col("moved") == "demoted", "candidate").otherwise(F.col("status")).alias("status"), "moved")


@R("SET02_edge_ends", "SELECT item, count(*) AS n FROM (SELECT id AS item FROM {CUR} WHERE supersedes IS NOT NULL UNION ALL SELECT supersedes FROM {CUR} WHERE supersedes IS NOT NULL) GROUP BY item")
def _(s, d):
    e = claims(s, d, "supersedes").where("supersedes IS NOT NULL")
    return e.select(F.explode(F.array("id", "supersedes")).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@R("AGG15_ingestion_metrics", """
SELECT count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'candidate') AS candidate, count(*) FILTER (status = 'superseded') AS superseded, round(avg(confidence) FILTER (status IN ('active', 'candidate')), 6) AS avg_confidence,
round(count(*) FILTER (status = 'active') / nullif(count(*) FILTER (status = 'active') + (SELECT count(DISTINCT id) FROM memory_discarded WHERE id IS NOT NULL), 0), 6) AS promotion_rate, round((SELECT count(DISTINCT id) FROM memory_discarded WHERE id IS NOT NULL) / nullif(count(*) FILTER (status = 'active') + (SELECT count(DISTINCT id) FROM memory_discarded WHERE id IS NOT NULL), 0), 6) AS rejection_rate, max(epoch_us(created_at)) AS last_us FROM {CUR}""")
def _(s, d):
    c = claims(s, d, "status", "confidence", "created_at")
    kept = c.agg(*[F.count_if(F.col("status") == x).alias(x) for x in ("active", "candidate", "superseded")], F.round(F.avg(F.when(F.col("status").isin("active", "candidate"), F.col("confidence"))), 6).alias("avg_confidence"), F.max(F.unix_micros("created_at")).alias("last_us"))
    gone = table(s, d, "memory_discarded").where("id IS NOT NULL").agg(F.count_distinct("id").alias("discarded"))
    rate = lambda c: F.round(F.try_divide(F.col(c), F.col("active") + F.col("discarded")), 6)
    # one row by one row
    return kept.crossJoin(gone).select("active", "candidate", "superseded", "avg_confidence", rate("active").alias("promotion_rate"), rate("discarded").alias("rejection_rate"), "last_us")


@R("AGG17_graph_coverage", """
WITH a AS (SELECT * FROM {CUR} WHERE status = 'active'), t AS (SELECT entity, count(*) AS n FROM a WHERE entity IS NOT NULL GROUP BY entity ORDER BY n DESC, entity LIMIT 10)
SELECT entity, n, (SELECT round(count(*) FILTER (entity IS NOT NULL AND property IS NOT NULL) / greatest(count(*), 1), 4) FROM a) AS coverage FROM t""")
def _(s, d):
    c = claims(s, d, "entity", "property", "status").where("status = 'active'")
    share = c.agg(F.round(F.count_if(F.col("entity").isNotNull() & F.col("property").isNotNull()) / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("coverage"))
    top = c.where("entity IS NOT NULL").groupBy("entity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity").limit(10)
    # ten rows by one row
    return top.crossJoin(share)


_FN = "(SELECT DISTINCT qualified_name, module_name FROM code_chunks WHERE chunk_type IN ('function', 'method') AND qualified_name IS NOT NULL)"


@R("FUN44_resolved_calls")
def _(s, d):
    """Calls in bodies as qualified names, in the stated order; parsed, so tested against a small fixture without SQL."""
    f = table(s, d, "code_chunks").where("chunk_type IN ('function', 'method')")
    return graph.resolved_calls(graph.calls_in(f), f)


@R("GRA06_code_graph")
def _(s, d):
    """All edges of the code graph; CALLS need a parser, so it is tested against a small fixture without SQL."""
    return graph.code_graph(table(s, d, "code_chunks"))


@R("GRA06_edges_without_calls", """
WITH c AS (SELECT * FROM code_chunks), f AS (SELECT * FROM c WHERE chunk_type IN ('function', 'method'))
SELECT DISTINCT file_path AS src, qualified_name AS dst, 'DEFINES' AS type FROM c WHERE chunk_type IN ('function', 'method', 'class') AND file_path IS NOT NULL AND qualified_name IS NOT NULL
UNION SELECT module_name || '.' || class_name, qualified_name, 'HAS_METHOD' FROM f WHERE chunk_type = 'method' AND module_name || '.' || class_name IN (SELECT qualified_name FROM c WHERE chunk_type = 'class') AND qualified_name IS NOT NULL
UNION SELECT p.qualified_name, f.qualified_name, 'CONTAINS' FROM f JOIN f p ON f.parent_chunk_id = p.id WHERE p.qualified_name IS NOT NULL AND f.qualified_name IS NOT NULL
UNION SELECT file_path, string_split(m, '.')[1], 'IMPORTS' FROM (SELECT file_path, unnest(imports) AS m FROM c WHERE chunk_type = 'module') WHERE m IS NOT NULL AND file_path IS NOT NULL""")
def _(s, d):
    return graph.code_graph(table(s, d, "code_chunks")).where("type <> 'CALLS'")


@R("GRA04_neighbours_of_code")
def _(s, d):
    """(name, relation, other): callers, callees, methods, imports and dependents of every function, class and file."""
    e = graph.code_graph(table(s, d, "code_chunks"))
    ways = {"CALLS": ("calls", "called_by"), "HAS_METHOD": ("methods", "method_of"), "IMPORTS": ("imports", "depended_on_by")}
    out = None
    for kind, (there, back) in ways.items():
        one = e.where(F.col("type") == kind)
        part = one.select(F.col("src").alias("name"), F.lit(there).alias("relation"), F.col("dst").alias("other")).unionByName(one.select(F.col("dst").alias("name"), F.lit(back).alias("relation"), F.col("src").alias("other")))
        out = part if out is None else out.unionByName(part)
    return out


@R("GRA05_dependency_map")
def _(s, d):
    """Per hit (every class and function whose text names a timeout) its callers, callees, methods and the files that import its module, with their number."""
    chunks = table(s, d, "code_chunks")
    hits = chunks.where("chunk_type IN ('function', 'method', 'class')").where(F.contains(F.lower(F.coalesce("body", F.lit(""))), F.lit("timeout"))).select(F.col("qualified_name").alias("name"), "module_name").distinct()
    e = materialize(graph.code_graph(chunks), "code-graph")
    near = e.where("type IN ('CALLS', 'HAS_METHOD')").select(F.col("src").alias("name"), F.when(F.col("type") == "CALLS", "calls").otherwise("methods").alias("relation"), F.col("dst").alias("other"))
    near = near.unionByName(e.where("type = 'CALLS'").select(F.col("dst").alias("name"), F.lit("called_by").alias("relation"), F.col("src").alias("other")))
    direct = hits.select("name").distinct().join(near, "name")
    files = e.where("type = 'IMPORTS'").select(F.col("dst").alias("module_name"), F.col("src").alias("other"))
    return direct.unionByName(hits.join(files, "module_name").select("name", F.lit("depended_on_by").alias("relation"), "other").distinct())


@R("GRA01_lookup_shapes", """
WITH c AS (SELECT DISTINCT entity, property, value, scope FROM {CUR} WHERE trim(coalesce(entity, ''), ' ') <> '' AND trim(coalesce(property, ''), ' ') <> '' AND trim(coalesce(value, ''), ' ') <> '')
(SELECT 'entity' AS shape, entity, property, value FROM (SELECT DISTINCT entity, property, value FROM c WHERE entity = 'general') ORDER BY property, value LIMIT 20)
UNION ALL (SELECT 'property', entity, property, value FROM (SELECT DISTINCT entity, property, value FROM c WHERE property = 'owner') ORDER BY entity, value LIMIT 20)
UNION ALL (SELECT 'both', entity, property, value FROM (SELECT DISTINCT entity, property, value FROM c WHERE entity = 'general' AND property = 'owner' AND scope = 'stable') ORDER BY value LIMIT 10)""")
def _(s, d):
    """Paths entity, property, value: by entity, by property, and by both within a scope; 20, 20 and 10 of them at most."""
    c = claims(s, d, "entity", "property", "value", "scope")
    for k in ("entity", "property", "value"):
        c = c.where(F.trim(F.coalesce(k, F.lit(""))) != "")
    take = lambda cond, shape, order, n: c.where(cond).select("entity", "property", "value").distinct().orderBy(*order).limit(n).select(F.lit(shape).alias("shape"), "entity", "property", "value")
    one = take("entity = 'general'", "entity", ["property", "value"], 20).unionByName(take("property = 'owner'", "property", ["entity", "value"], 20))
    return one.unionByName(take("entity = 'general' AND property = 'owner' AND scope = 'stable'", "both", ["value"], 10))


@R("AGG21_cohorts_with_labels", """
WITH a AS (SELECT id, coalesce(last_confirmed, first_seen, created_at) AS t, row_number() OVER (ORDER BY id) - 1 AS i FROM {CUR}), b AS (SELECT *, greatest(epoch_us({AS_OF}) - epoch_us(t), 0) / 86400000000.0 AS age FROM a),
k AS (SELECT *, CASE WHEN t IS NULL THEN 'undated' WHEN age < 1 THEN 'today' WHEN age < 7 THEN 'this_week' WHEN age < 31 THEN 'this_month' ELSE 'older' END AS cohort FROM b)
SELECT cohort, count(*) AS n, round(min(age) FILTER (t IS NOT NULL), 6) AS newest_age, round(max(age) FILTER (t IS NOT NULL), 6) AS oldest_age, list_position(['today', 'this_week', 'this_month', 'older', 'undated'], cohort) AS place FROM k GROUP BY cohort""")
def _(s, d):
    at = F.coalesce("last_confirmed", "first_seen", "created_at")
    age = temporal.age_days(at, as_of())
    c = claims(s, d, "last_confirmed", "first_seen", "created_at").select(temporal.bucket(age).alias("cohort"), age.alias("age"))
    order = F.array(*[F.lit(x) for x in ("today", "this_week", "this_month", "older", "undated")])
    g = c.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("age"), 6).alias("newest_age"), F.round(F.max("age"), 6).alias("oldest_age"))
    return g.withColumn("place", F.array_position(order, F.col("cohort")).cast("int"))
