"""Text expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_ws(c: Column) -> Column:
    """Without surrounding white space of any kind (Unicode White_Space, so the no-break space too)."""
    return F.regexp_replace(c, r"(?U)^\s++|\s++\z", "")


def fold_ws(c: Column) -> Column:
    """Trimmed, with each run of white space made one space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s++", " "))


def plain_decimal(c: Column) -> Column:
    """The number of a plain decimal text (sign allowed, spaces around ignored), else null."""
    t = F.trim(c)
    return F.when(t.rlike(r"\A[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)\z"), t).try_cast("double")
