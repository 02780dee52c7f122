"""Property graphs as node and edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamspark.session import materialize


def claim_edges(claims: DataFrame) -> DataFrame:
    """(src, dst, type): scope, entity, property and value edges of each claim, each once.

    Claims without an entity, property or value have no edge to it. Node names carry their kind.
    """
    node = lambda kind, c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(f"{kind}:"), F.col(c)))
    item, scope = F.concat(F.lit("item:"), F.col("id")), F.concat(F.lit("scope:"), F.coalesce("scope", F.lit("stable")))
    entity, prop, value = node("entity", "entity"), node("property", "property"), node("value", "value")
    edges = [(item, scope, "ASSERTED_IN"), (scope, item, "CONTAINS"), (item, entity, "ABOUT_ENTITY"), (entity, prop, "HAS_PROPERTY"), (prop, value, "HAS_VALUE")]
    each = F.array(*[F.struct(a.alias("src"), b.alias("dst"), F.lit(t).alias("type")) for a, b, t in edges])
    return claims.select(F.inline(each)).where("src IS NOT NULL AND dst IS NOT NULL").dropDuplicates(["src", "dst", "type"])


def code_edges(chunks: DataFrame) -> DataFrame:
    """(src, dst, type): files define their chunks, classes have methods, chunks import modules."""
    file, name = F.concat(F.lit("file:"), F.col("file_path")), F.concat(F.lit("code:"), F.col("qualified_name"))
    defines = chunks.select(file.alias("src"), name.alias("dst"), F.lit("DEFINES").alias("type"))
    methods = chunks.where("class_name IS NOT NULL AND chunk_type = 'method'").select(F.concat(F.lit("class:"), F.col("module_name"), F.lit("."), F.col("class_name")).alias("src"), name.alias("dst"), F.lit("HAS_METHOD").alias("type"))
    imports = chunks.select(file.alias("src"), F.explode("imports").alias("m")).where("m IS NOT NULL").select("src", F.concat(F.lit("module:"), F.col("m")).alias("dst"), F.lit("IMPORTS").alias("type"))
    return defines.unionByName(methods).unionByName(imports).where("src IS NOT NULL AND dst IS NOT NULL").dropDuplicates(["src", "dst", "type"])


def k_hops(edges: DataFrame, starts: DataFrame, depth: int, types: Sequence[str] | None = None) -> DataFrame:
    """(start, node, hops): nodes within `depth` undirected steps of each start, by their least number of steps.

    One join per step with the frontier only; reached pairs are left out of later frontiers, so cycles end. The start
    itself is not among its nodes. Frontiers are written between steps, which keeps the lineage short.
    """
    e = edges if types is None else edges.where(F.col("type").isin(*types))
    both = materialize(e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both-ways")
    reached = frontier = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("hops")).distinct()
    for hop in range(1, depth + 1):
        step = frontier.join(both, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(reached.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hop)), f"hop-{hop}")
        reached = reached.unionByName(frontier)
    return reached.where("hops > 0")


def calls_in(bodies: DataFrame) -> DataFrame:
    """(caller, module_name, call) of (qualified_name, module_name, body): names called in each body, once; calls on self
    or cls are left out, bodies that don't parse have none."""
    import ast
    import textwrap
    from collections.abc import Iterator

    import pyarrow as pa

    def named(f) -> str | None:
        parts = []
        while isinstance(f, ast.Attribute):
            parts.append(f.attr)
            f = f.value
        if not isinstance(f, ast.Name) or (parts and f.id in ("self", "cls")):
            return None
        return ".".join([f.id, *reversed(parts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, module, body in zip(b["qualified_name"].to_pylist(), b["module_name"].to_pylist(), b["body"].to_pylist(), strict=True):
                try:
                    tree = ast.parse(textwrap.dedent(body or ""))
                except (SyntaxError, ValueError, RecursionError):
                    continue
                found = {named(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)} - {None}
                rows += [(name, module, c) for c in sorted(found)]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["caller", "module_name", "call"])

    fit = bodies.where("qualified_name IS NOT NULL AND trim(coalesce(body, '')) <> ''").select("qualified_name", "module_name", "body").distinct()
    return fit.mapInArrow(run, "caller string, module_name string, call string")


def resolved_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(caller, callee): calls as qualified names of functions(qualified_name, module_name, chunk_type): the name itself;
    else in the caller's module; else a name that one module alone has; else the last part of a dotted name, likewise.

    Each step is an equi-join, so nothing is looked up on the driver. Calls of themselves and unresolved ones are left out.
    """
    known = functions.where("qualified_name IS NOT NULL").select(F.col("qualified_name").alias("q"), "module_name").distinct()
    names = known.select("q").distinct()
    short = F.substring_index("q", ".", -1)
    single = known.select(short.alias("short"), "q", "module_name").groupBy("short").agg(F.count_distinct("module_name").alias("modules"), F.min("q").alias("only"), F.count_distinct("q").alias("n")).where("modules = 1 AND n = 1").select("short", "only")
    c = calls.withColumns({"local": F.concat_ws(".", "module_name", "call"), "last": F.substring_index("call", ".", -1)}).distinct()
    by = lambda df, on, name: df.join(names.select(F.col("q").alias(on), F.col("q").alias(name)), on, "left")
    c = by(by(c, "call", "exact"), "local", "same")
    c = c.join(single.select(F.col("short").alias("call"), F.col("only").alias("unique")), "call", "left").join(single.select(F.col("short").alias("last"), F.col("only").alias("dotted")), "last", "left")
    callee = F.coalesce("exact", "same", "unique", F.when(F.contains("call", F.lit(".")), F.col("dotted")))
    return c.select("caller", callee.alias("callee")).where("callee IS NOT NULL AND callee <> caller").distinct()


def code_graph(chunks: DataFrame) -> DataFrame:
    """(src, dst, type): DEFINES, HAS_METHOD, CONTAINS, IMPORTS and CALLS edges of code chunks, each once.

    CONTAINS leads from a function to one within it (by parent_chunk_id); IMPORTS names the top module of what modules
    import; CALLS are resolved_calls(). Edges need both ends, as a graph store would match them.
    """
    edge = lambda df, a, b, kind: df.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("type")).where("src IS NOT NULL AND dst IS NOT NULL")
    functions = chunks.where("chunk_type IN ('function', 'method')")
    classes = chunks.where("chunk_type = 'class'")
    defines = edge(chunks.where("chunk_type IN ('function', 'method', 'class')"), "file_path", "qualified_name", "DEFINES")
    methods = functions.where("chunk_type = 'method' AND class_name IS NOT NULL").withColumn("owner", F.concat_ws(".", "module_name", "class_name"))
    methods = edge(methods.join(classes.select(F.col("qualified_name").alias("owner")).distinct(), "owner", "left_semi"), "owner", "qualified_name", "HAS_METHOD")
    parents = functions.select(F.col("id").alias("parent_chunk_id"), F.col("qualified_name").alias("outer"))
    contains = edge(functions.join(parents, "parent_chunk_id"), "outer", "qualified_name", "CONTAINS")
    imports = chunks.where("chunk_type = 'module'").select("file_path", F.explode("imports").alias("m")).withColumn("m", F.substring_index("m", ".", 1))
    calls = resolved_calls(calls_in(functions), functions)
    parts = [defines, methods, contains, edge(imports, "file_path", "m", "IMPORTS"), edge(calls, "caller", "callee", "CALLS")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
