"""Predicates of specifications as Column expressions; a predicate that does not parse fails, it never passes rows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_sql(query: str) -> str:
    """Data-frame query text as SQL: == to =, & and | to AND and OR, x.isna() to IS NULL."""
    out = re.sub(r"([A-Za-z_]\w*)\.isna\(\)", r"\1 IS NULL", query)
    out = re.sub(r"([A-Za-z_]\w*)\.notna\(\)", r"\1 IS NOT NULL", out)
    return re.sub(r"\|", " OR ", re.sub(r"&", " AND ", out.replace("==", "="))).replace('"', "'")


def condition(query: str | None) -> Column:
    return F.lit(True) if not query else F.expr(to_sql(query))


def segment(column: str, value) -> Column:
    return F.col(column).isNull() if value is None else F.col(column) == F.lit(value)


def interval(column: str, low=None, high=None, closed: str = "both") -> Column:
    """Nine kinds: equality by low == high, one open or closed end, or two."""
    c, out = F.col(column), F.lit(True)
    if low is not None:
        out = out & ((c >= low) if closed in ("both", "left") else (c > low))
    if high is not None:
        out = out & ((c <= high) if closed in ("both", "right") else (c < high))
    return out


def category(column: str, value) -> Column:
    """Categories compare as text."""
    return F.col(column).cast("string") == F.lit(str(value))
