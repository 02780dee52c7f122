"""Ages, buckets, labels and recency scores of rows in time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def age_days(at: Column, now: Column) -> Column:
    """Days between at and now as a fraction, never negative; null for null."""
    return F.when(at.isNotNull(), F.greatest((F.unix_micros(now) - F.unix_micros(at)) / F.lit(float(DAY_US)), F.lit(0.0)))


def bucket(age: Column) -> Column:
    """today (under 1 day), this_week (7), this_month (31), older; undated for null."""
    return F.when(age.isNull(), "undated").when(age < 1, "today").when(age < 7, "this_week").when(age < 31, "this_month").otherwise("older")


def half_life(age: Column, days: float, weight: float) -> Column:
    """weight halved every `days`; 0 for null."""
    return F.coalesce(weight * F.pow(F.lit(0.5), age / days), F.lit(0.0))


def log_decay(age: Column) -> Column:
    """Recency that falls with the logarithm of age, minus a penalty for staleness beyond 60 days (fixed weights)."""
    fresh = F.when(age <= 1, 0.10).otherwise(0.10 / (1 + F.log2(1 + age / 14)))
    stale = F.when(age > 60, -0.08 * F.least((age - 60) / 180, F.lit(1.0))).otherwise(0.0)
    return F.coalesce(fresh + stale, F.lit(0.0))


def label(age: Column) -> Column:
    """N hours/days/weeks/months/years ago, rounded half to even."""
    n = lambda x: F.bround(x).cast("long").cast("string")
    return (
        F.when(age.isNull(), "undated").when(age * 24 < 1, "just now").when(age < 1, F.concat(n(age * 24), F.lit(" hours ago"))).when(age < 7, F.concat(n(age), F.lit(" days ago")))
        .when(age < 31, F.concat(n(age / 7), F.lit(" weeks ago"))).when(age < 365, F.concat(n(age / 30), F.lit(" months ago"))).otherwise(F.concat(n(age / 365), F.lit(" years ago")))
    )
