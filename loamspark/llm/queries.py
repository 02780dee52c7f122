"""Registered queries of the training-data problems."""

from __future__ import annotations

from loamspark.llm import batch_dedup, bpe, curve_knn, group_topn, leakage, mojibake
from loamspark.llm.sql import SQL  # noqa: F401
from loamspark.session import table


def p1_found(spark, sf_dir):
    return curve_knn.similar_chunks(spark, sf_dir)


def p3_found(spark, sf_dir):
    return batch_dedup.duplicate_claims(spark, sf_dir)


def p4_found(spark, sf_dir):
    return group_topn.latest_claims(table(spark, sf_dir, "memory_items"))


def p6_ids(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"))


def _leaks(spark, sf_dir):
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark, sf_dir):
    """Documents that share a passage word for word."""
    return _leaks(spark, sf_dir).where("verbatim > 0").select("doc_id", "item_id")


def p7_reparameterised(spark, sf_dir):
    """Documents that hold a passage with other numbers, names or units only."""
    return _leaks(spark, sf_dir).where("verbatim = 0 AND reparameterised > 0").select("doc_id", "item_id", "reparameterised")


def p8_found(spark, sf_dir):
    return mojibake.garbled_documents(table(spark, sf_dir, "documents")).select("doc_id")


def p8_restored(spark, sf_dir):
    """Garbled documents with their original text, null where it is lost for good."""
    return mojibake.restored_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p4_found, p6_ids, p7_found, p7_reparameterised, p8_found, p8_restored)}
