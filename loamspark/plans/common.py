"""Registry of queries, and the inputs they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamspark.operators.rows import current_rows
from loamspark.session import table

#: The instant that ages and recency are measured from, so that results can be repeated.
AS_OF = "2026-09-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


CLAIM_FIELDS = (
    "text memory_type scope project_id entity property value status confidence importance freshness_class source_agent source_session "
    "first_seen last_confirmed supersedes tags sensitivity created_at updated_at lifecycle_state reinforcement_count suggested_route target_file"
).split()


class Registry:
    """Collects queries and their SQL by name."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable] = {}
        self.SQL: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f):
            self.QUERIES[name] = f
            if sql:
                self.SQL[name] = sql.replace("{CUR}", CUR).replace("{FB}", FB).replace("{AS_OF}", f"TIMESTAMPTZ '{AS_OF}+00'").replace("{TURNS}", TURNS)
            return f

        return add


#: SQL of the current rows of memory_items, of feedback derived from events, and of turns derived from documents.
CUR = "(SELECT * FROM memory_items WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
FB = """(SELECT event_id, CAST(user_id AS VARCHAR) AS selected_id, event_type AS query_type, ts AS feedback_at, value,
 CASE event_type WHEN 'purchase' THEN 'useful' WHEN 'signup' THEN 'useful' WHEN 'error' THEN 'bad' END AS operator_feedback,
 props AS query_text FROM events)"""
TURNS = "(SELECT doc_id, source AS session_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn_index, text FROM documents)"


def claims(spark, d: str, *fields: str) -> DataFrame:
    """Current rows of memory_items with the fields asked for."""
    return current_rows(table(spark, d, "memory_items"), "id", "updated_at", list(fields) or CLAIM_FIELDS)


def feedback(spark, d: str) -> DataFrame:
    """Retrieval feedback as the events table tells it."""
    e = table(spark, d, "events")
    mark = F.when(F.col("event_type").isin("purchase", "signup"), "useful").when(F.col("event_type") == "error", "bad")
    return e.select("event_id", F.col("user_id").cast("string").alias("selected_id"), F.col("event_type").alias("query_type"), F.col("ts").cast("timestamp").alias("feedback_at"), "value", mark.alias("operator_feedback"), F.col("props").alias("query_text"))


def slot_present(*cols: str):
    out = F.lit(True)
    for c in cols:
        out = out & (F.coalesce(F.col(c), F.lit("")) != "")
    return out
