"""All registered queries outside the llm subpackage."""

from __future__ import annotations

from loamspark.plans import aggregate_queries, extra_queries, graph_queries, join_queries, link_queries, more_queries, problems, report_queries, retrieval_queries, search_queries, store_queries, stream_queries, text_queries, whole_queries

MODULES = [problems, store_queries, join_queries, aggregate_queries, retrieval_queries, graph_queries, stream_queries, more_queries, extra_queries, search_queries, text_queries, link_queries, report_queries, whole_queries]


def queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.SQL.items()}


def flagship(spark, sf_dir):
    return search_queries.hybrid(spark, sf_dir)
