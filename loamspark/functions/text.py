"""Column expressions on text that all operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the data model: spaces, tabs and line breaks.
SPACE = "[ \\t\\r\\n]+"


def fold(c: Column) -> Column:
    """Trim white space and make each inner run of it one space; null stays null."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def not_blank(c: Column) -> Column:
    """True where c holds a character besides white space; false for null."""
    return F.coalesce(F.length(F.trim(F.regexp_replace(c, SPACE, " "))) > 0, F.lit(False))


def slot_key(c: Column) -> Column:
    """The form in which entities and properties name a slot."""
    return F.lower(fold(c))
