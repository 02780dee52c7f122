"""Retrieval as a whole: query terms, vectors of texts, cover-density rank over all fields, the final scores, reranks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamspark.operators import retrieval

#: Words that are no query terms in the filtered search, beside the others (fixed values).
FILTERED_STOP_WORDS = [*retrieval.STOP_WORDS, *"person does what where love enjoy".split()]
#: Fields that full-text search reads, in order (fixed values).
TEXT_FIELDS = ("text", "entity", "property", "value", "memory_type", "scope")
#: Weight of a cover of query words without other words between them (fixed value).
COVER = 0.1
DIMENSIONS = 64


def terms(text: Column, stop: Sequence[str] = retrieval.STOP_WORDS) -> Column:
    """Array of the query terms of a text column, repeats kept; an empty array for null."""
    return F.filter(retrieval.tokens(text), lambda t: (F.length(t) >= 4) & ~t.isin(*stop))


def term_list(query: str, stop: Sequence[str] = retrieval.STOP_WORDS) -> list[str]:
    """terms() of one query."""
    return [t for t in re.sub(r"[^a-z0-9_ ]", " ", query.lower()).split(" ") if len(t) >= 4 and t not in stop]


def _cells(tokens: list[str], seen: dict[str, tuple[int, int]]) -> np.ndarray:
    x = np.zeros(DIMENSIONS)
    for t in tokens:
        if t not in seen:
            if len(seen) > 500_000:
                seen.clear()
            digest = hashlib.md5(t.encode()).hexdigest()
            seen[t] = int(digest[:7], 16) % DIMENSIONS, 1 if int(digest[8], 16) < 8 else -1
        at, sign = seen[t]
        x[at] += sign
    return x


def vector_scores(df: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, vector): cosine of each text's vector of signed hashed tokens with the query's; 0 for zero vectors.

    The stand-in for a sentence encoder where no model is at hand. Texts without tokens are left out, as items without an
    embedding are. No shuffle.
    """
    q = _cells([t for t in re.sub(r"[^a-z0-9_ ]", " ", query.lower()).split(" ") if t], {})
    q = q / (np.linalg.norm(q) or 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[int, int]] = {}
        for b in batches:
            x = np.array([_cells(ts, seen) for ts in b["ts"].to_pylist()]).reshape(-1, DIMENSIONS)
            n = np.linalg.norm(x, axis=1)
            yield pa.record_batch([b["key"], pa.array(np.where(n > 0, x @ q / np.where(n > 0, n, 1), 0.0))], ["key", "vector"])

    kind = dict(df.dtypes)[key]
    held = df.select(F.col(key).alias("key"), retrieval.tokens(F.col(text)).alias("ts")).where("size(ts) > 0")
    return held.mapInArrow(run, f"key {kind}, vector double").withColumnRenamed("key", key)


def web_query(query: str) -> tuple[list[list[list[str]]], list[list[str]]]:
    """(all of these groups, none of these phrases): a group is a list of alternatives, each a phrase of stemmed words.

    Words are joined by "and", `or` between two makes them alternatives, quotes make a phrase, a minus excludes.
    """
    stem = lambda w: re.sub(r"(ies|es|s|ing|ed)$", "", w)
    wanted: list[list[list[str]]] = []
    banned: list[list[str]] = []
    alternative = False
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query.lower()):
        if word == "or" and not minus and wanted:
            alternative = True
            continue
        phrase = [stem(w) for w in re.sub(r"[^a-z0-9_ ]", " ", quoted or word).split()]
        if phrase:
            (banned if minus else wanted[-1] if alternative else wanted).append(phrase if minus or alternative else [phrase])
        alternative = False
    return wanted, banned


def covers(words: Sequence[str], wanted: list[list[list[str]]], banned: list[list[str]]) -> float:
    """Sum over the minimal runs that hold each group once: COVER / (1 + words between); 0 if a group is missing."""
    at = lambda phrase: [i + len(phrase) - 1 for i in range(len(words) - len(phrase) + 1) if list(words[i : i + len(phrase)]) == phrase]
    if not wanted or any(at(p) for p in banned):
        return 0.0
    hits = sorted((i, g) for g, alternatives in enumerate(wanted) for p in alternatives for i in at(p))
    last: dict[int, int] = {}
    start, total = -1, 0.0
    for i, g in hits:
        last[g] = i
        if len(last) == len(wanted) and min(last.values()) > start:
            start = min(last.values())
            total += COVER / (1 + max(0, i - start - (len(wanted) - 1)))
    return total


def text_rank(query: str, fields: Sequence[str] = TEXT_FIELDS) -> Column:
    """Cover-density rank of the joined fields for a query in web search syntax; an Arrow UDF over word positions."""
    wanted, banned = web_query(query)

    @F.arrow_udf("double")
    def rank(held: pa.Array) -> pa.Array:
        return pa.array([covers(w or [], wanted, banned) for w in held.to_pylist()], pa.float64())

    joined = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields])
    # rows without the first group's words can't rank: they don't reach Python
    words = F.transform(retrieval.tokens(joined), retrieval.stem)
    any_of = F.array(*[F.lit(p[0]) for p in wanted[0]]) if wanted else F.array().cast("array<string>")
    return F.coalesce(rank(F.when(F.arrays_overlap(words, any_of), words)), F.lit(0.0))


def final_score(fts: Column, vector: Column, structured: Column, recency: Column) -> Column:
    """3 fts + 1.1 vector + structured + .2 + .6 recency."""
    return 3.0 * fts + 1.1 * vector + structured + 0.2 + 0.6 * recency


def filtered_final_score(fts: Column, vector: Column, structured: Column, relative: Column, absolute: Column) -> Column:
    """3 fts + 1.1 vector + structured + .2 + relative + absolute recency, both already weighted."""
    return 3.0 * fts + 1.1 * vector + structured + 0.2 + relative + absolute


def rerank(df: DataFrame, order: Sequence[Column], key: Sequence[str], head: int, raw: Column, blend: bool) -> DataFrame:
    """All rows with place (1 ..): the first `head` by `order` are ordered anew by their raw score, the tail follows as it was.

    blend: the new score is .35 * score + 1.25 * sigmoid(raw); else raw. head bounds the rows that are scored, so the
    whole table is never sorted in one task: ranks of the tail come from a range-partitioned sort.
    """
    top = df.orderBy(*order).limit(head)
    fresh = 0.35 * F.col("score") + 1.25 / (1 + F.exp(-raw)) if blend else raw
    rows = [r.asDict(recursive=True) for r in top.withColumn("reranked", fresh).orderBy(F.desc("reranked"), *order).collect()]  # at most `head`
    spark = df.sparkSession
    first = spark.createDataFrame([{**r, "place": i + 1} for i, r in enumerate(rows)], top.withColumns({"reranked": F.lit(0.0), "place": F.lit(0)}).schema) if rows else df.withColumns({"reranked": F.lit(None).cast("double"), "place": F.lit(0)}).limit(0)
    tail = df.join(F.broadcast(first.select(*key)), list(key), "left_anti").withColumns({"reranked": F.lit(None).cast("double"), "place": F.lit(None).cast("int")})
    return first.unionByName(tail)
