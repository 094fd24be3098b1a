"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(column: Column | str, lower: bool = False) -> Column:
    """The value without white space around it, in lower case on request; null where nothing is left."""
    c = F.col(column) if isinstance(column, str) else column
    c = F.regexp_replace(c.cast("string"), r"^(?U:\s)+|(?U:\s)+$", "")
    c = F.lower(c) if lower else c
    return F.when(c != "", c)
