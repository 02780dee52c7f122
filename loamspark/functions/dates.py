"""Time expressions: a small language for "since", and references to time inside queries."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "january february march april may june july august september october november december".split()
UNITS = {"hour": 1 / 24, "day": 1, "week": 7, "month": 30, "year": 365}


def parse_since(text: str, now: datetime) -> datetime | None:
    """today, yesterday, week, N followed by h, d or w, or an ISO date; None if it is none of these."""
    t = (text or "").strip().lower()
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    fixed = {"today": midnight, "yesterday": midnight - timedelta(days=1), "week": now - timedelta(days=7)}
    if t in fixed:
        return fixed[t]
    if m := re.fullmatch(r"(\d+)([hdw])", t):
        return now - timedelta(hours=int(m[1]) * {"h": 1, "d": 24, "w": 168}[m[2]])
    try:
        return datetime.fromisoformat(t)
    except ValueError:
        return None


def time_reference(query: str, now: datetime) -> tuple[datetime, datetime] | None:
    """(start, end) that a query refers to: an ISO day, N units ago (a day either way), last N units, a month."""
    q = (query or "").lower()
    if m := re.search(r"\b(\d{4})-(\d{2})-(\d{2})\b", q):
        try:
            day = datetime(int(m[1]), int(m[2]), int(m[3]))
        except ValueError:
            return None
        return day, day + timedelta(days=1)
    if m := re.search(r"\b(\d+) (hour|day|week|month|year)s? ago\b", q):
        at = now - timedelta(days=int(m[1]) * UNITS[m[2]])
        return at - timedelta(days=1), at + timedelta(days=1)
    if m := re.search(r"\blast (\d+)? ?(hour|day|week|month|year)s?\b", q):
        return now - timedelta(days=int(m[1] or 1) * UNITS[m[2]]), now
    if m := re.search(rf"\b(?:in )?({'|'.join(MONTHS)})(?: (\d{{4}}))?\b", q):
        month, year = MONTHS.index(m[1]) + 1, int(m[2]) if m[2] else now.year
        if not m[2] and month > now.month:
            year -= 1
        return datetime(year, month, 1), datetime(year + month // 12, month % 12 + 1, 1)
    return None


def is_temporal(query: Column) -> Column:
    """Whether a query asks about time: at least two time words, or more than 12 % of its words."""
    words = r"\b(when|today|yesterday|recent(ly)?|latest|last|ago|before|after|since|until|week|month|year|day)\b"
    hits = F.regexp_count(F.lower(query), F.lit(words))
    return (hits >= 2) | (hits / F.greatest(F.regexp_count(query, F.lit(r"\S+")), F.lit(1)) > 0.12)
