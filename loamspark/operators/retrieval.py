"""Hybrid retrieval: analysed text, full-text rank, vector similarity, overlap bonuses, recency, fusion, top-k."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that carry no meaning in a query (fixed values).
STOP_WORDS = "this that with from into they them then than have will would could should there their about because system".split()
#: Weight of a query term found in each field, and of each part of the final score (fixed values).
FIELD_WEIGHTS = {"text": 0.18, "entity": 0.20, "property": 0.45, "value": 0.55}
SCORE_WEIGHTS = {"fts": 3.0, "vector": 1.1, "recency": 0.6}
IMPORTANCE_BONUS = 0.2


def query_terms(query: str) -> list[str]:
    """Terms of a query: lower case, letters, digits and underscores, at least four of them, no stop words."""
    return [t for t in re.sub(r"[^a-z0-9_ ]", " ", query.lower()).split() if len(t) >= 4 and t not in STOP_WORDS]


def tokens(c: Column) -> Column:
    """Lower-case word tokens of a text column."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9_ ]", " "), " +"), lambda t: t != "")


def overlap_bonus(terms: Sequence[str], weights: dict[str, float] = FIELD_WEIGHTS) -> Column:
    """Weighted number of query terms that each field holds as a whole token; repeated terms count again."""
    total = F.lit(0.0)
    for field, weight in weights.items():
        held = tokens(F.col(field))
        for t in terms:
            total = total + F.when(F.array_contains(held, t), weight).otherwise(0.0)
    return total


def stem(c: Column) -> Column:
    """Light English stemming by suffix, enough for plural and tense to meet."""
    return F.regexp_replace(c, "(ies|es|s|ing|ed)$", "")


def text_rank(terms: Sequence[str], field: Column) -> Column:
    """Share of the stemmed query terms that occur, damped by length: 0 if one is missing.

    Stays in generated code; ranks by coverage and closeness only as far as length stands for it.
    """
    if not terms:
        return F.lit(0.0)
    held = F.transform(tokens(field), stem)
    stems = [re.sub(r"(ies|es|s|ing|ed)$", "", t) for t in terms]
    every = F.lit(True)
    for t in stems:
        every = every & F.array_contains(held, t)
    return F.when(every, F.lit(float(len(stems))) / (1 + F.log(1 + F.size(held).cast("double")))).otherwise(0.0)


def cover_density(terms: Sequence[str], field: str) -> Column:
    """Inverse length of the shortest window of tokens that holds all terms; 0 if there is none.

    Two passes over the positions of the terms, in an Arrow UDF: a sliding window has no column expression.
    """
    wanted = list(dict.fromkeys(re.sub(r"(ies|es|s|ing|ed)$", "", t) for t in terms))

    @F.arrow_udf("double")
    def rank(held: pa.Array) -> pa.Array:
        out = []
        for words in held.to_pylist():
            best, last = 0.0, {}
            for i, w in enumerate(words or []):
                if w in wanted:
                    last[w] = i
                    if len(last) == len(wanted):
                        best = max(best, 1.0 / (i - min(last.values()) + 1))
            out.append(best)
        return pa.array(out, pa.float64())

    return rank(F.transform(tokens(F.col(field)), stem)) if wanted else F.lit(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns in double precision; null for a zero or null vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similarity(df: DataFrame, key: str, vector: str, query: Sequence[float]) -> DataFrame:
    """(key, score): cosine of each vector with one query vector, a matrix product per batch."""
    q = np.asarray(query, np.float64)
    q = q / np.linalg.norm(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b[vector].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            n = np.linalg.norm(x, axis=1)
            yield pa.record_batch([b[key], pa.array(np.where(n > 0, x @ q / np.where(n > 0, n, 1), 0.0))], ["key", "score"])

    kind = dict(df.dtypes)[key]
    fit = df.where((F.size(vector) == len(q)) & F.col(key).isNotNull() & ~F.exists(vector, lambda v: v.isNull()))
    return fit.select(key, vector).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def hybrid_score(terms: Sequence[str], recency: Column, fts: Column, vector: Column | None = None) -> Column:
    """Final score: weighted sum of full-text rank, vector similarity, overlap and importance bonuses and recency."""
    w = SCORE_WEIGHTS
    return w["fts"] * fts + w["vector"] * (F.lit(0.0) if vector is None else F.coalesce(vector, F.lit(0.0))) + overlap_bonus(terms) + IMPORTANCE_BONUS + w["recency"] * recency


def metrics_at(ranked: DataFrame, relevant: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """(query, recall, precision, mrr, ndcg) at k of ranked(query, item, rank) against relevant(query, item, gain).

    Queries with nothing relevant score 0; precision divides by k; gains are linear.
    """
    top = ranked.where(F.col("rank") <= k)
    hits = top.join(relevant, [query, item]).groupBy(query).agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(F.col("gain") / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    from pyspark.sql import Window

    w = Window.partitionBy(query).orderBy(F.desc("gain"), item)
    ideal = relevant.withColumn("r", F.row_number().over(w)).groupBy(query).agg(F.count(F.lit(1)).alias("wanted"), F.sum(F.when(F.col("r") <= k, F.col("gain") / F.log2(F.col("r") + 1.0))).alias("ideal"))
    both = ranked.select(query).distinct().join(ideal, query, "left").join(hits, query, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(query, zero(F.try_divide("hits", "wanted")).alias("recall"), zero(F.col("hits") / float(k)).alias("precision"), zero(1.0 / F.col("first")).alias("mrr"), zero(F.try_divide("dcg", "ideal")).alias("ndcg"))


def hashed_vectors(df: DataFrame, key: str, text: str, dimensions: int = 384) -> DataFrame:
    """(key, embedding): unit vectors of signed hashed tokens, the encoder where no model is at hand.

    Equal texts have equal vectors; texts without tokens have the zero vector. Built from column expressions only.
    """
    t = df.select(key, F.explode_outer(tokens(F.col(text))).alias("t"))
    place = F.pmod(F.xxhash64("t"), F.lit(dimensions)).cast("int")
    sign = F.when(F.pmod(F.xxhash64("t", F.lit("sign")), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    cells = t.groupBy(key, place.alias("i")).agg(F.sum(F.when(F.col("t").isNotNull(), sign)).alias("x"))
    # at most `dimensions` cells per key
    rows = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("i", "x")))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    value = lambda i: F.coalesce(F.try_divide(F.try_element_at("m", i.cast("int")), F.col("n")), F.lit(0.0)).cast("float")
    return rows.select(key, F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), value).alias("embedding"))
