"""Row expressions: treatment of missing and infinite values, interactions, bins, weight of evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_nan(c: Column) -> Column:
    """NaN as null, for intake."""
    return F.when(F.isnan(c), None).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    """Null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def treat(c: Column, nan: float | None = None, inf: float | None = None) -> Column:
    """Nulls and NaN become ``nan``; infinities become ``inf`` with their sign."""
    d = c.cast("double")
    out = d if inf is None else F.when(d == float("inf"), F.lit(float(inf))).when(d == float("-inf"), F.lit(-float(inf))).otherwise(d)
    out = clean_nan(out)
    return out if nan is None else F.coalesce(out, F.lit(float(nan)))


def fill_ratio(a: Column, b: Column, nan: float | None = None, inf: float | None = None) -> Column:
    """a / b, where x / 0 is ``inf`` with the sign of x, and 0 / 0 or null is ``nan``."""
    fill = F.lit(None if nan is None else float(nan))
    over = F.when(a == 0, fill).otherwise(F.signum(a) * F.lit(None if inf is None else float(inf)))
    return F.when(a.isNull() | b.isNull(), fill).when(b == 0, over).otherwise(ratio(a, b))


def interact(kind: str, a: Column, b: Column, nan: float | None = None, inf: float = 0.0) -> Column:
    """Sum, product, difference, ratio, equality or cartesian of two columns."""
    if kind == "sum":
        return treat(a, nan) + treat(b, nan)
    if kind == "product":
        return treat(a, nan) * treat(b, nan)
    if kind == "difference":
        return treat(a, nan) - treat(b, nan)
    if kind == "ratio":
        return fill_ratio(treat(a, nan), treat(b, nan), nan, inf)
    if kind == "equality":
        return F.when(a < b, "<").when(a == b, "=").when(a > b, ">").otherwise(a.cast("string"))
    if kind == "cartesian":
        return F.concat_ws("_", F.coalesce(a.cast("string"), F.lit("NaN")), F.coalesce(b.cast("string"), F.lit("NaN")))
    raise ValueError(f"unknown interaction {kind!r}")


def text_length(c: Column) -> Column:
    return F.length(F.coalesce(c, F.lit(""))).cast("long")


def logit(p: Column) -> Column:
    """Null at 0 and 1, where it has no value, and beyond."""
    return F.log(F.try_divide(p, 1 - p))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bin_index(c: Column, edges: Sequence[float], closed: str = "left") -> Column:
    """Number of the interval between inner edges: [a, b) if closed left, (a, b] if right; null stays null."""
    above = (lambda e: c >= F.lit(float(e))) if closed == "left" else (lambda e: c > F.lit(float(e)))
    total = F.lit(0)
    for e in edges:
        total = total + above(e).cast("int")
    return F.when(c.isNotNull(), total)


def bin_by(c: Column, edges: Column, closed: str = "left") -> Column:
    """The same with an array column of edges."""
    above = (lambda e: c >= e) if closed == "left" else (lambda e: c > e)
    return F.when(c.isNotNull(), F.size(F.filter(edges, above)))


def equal_width(c: Column, low: Column, high: Column, n: int) -> Column:
    """Numbers 0 to n - 1; the last interval holds its upper end."""
    return F.when(c.isNotNull(), F.least(F.lit(n - 1), F.when(high == low, 0).otherwise(F.floor((c - low) / (high - low) * n))).cast("int"))


def woe(bads: Column, total: Column, all_bads: Column, all_total: Column, smooth: float = 0.001) -> Column:
    """ln((good rate + s) / (bad rate + s)) less the same of all rows; 0 for an empty bin. Rates, not counts."""
    bad, all_bad = ratio(bads, total), ratio(all_bads, all_total)
    side = lambda b: F.log((1 - b + smooth) / (b + smooth))
    return F.when(total > 0, side(bad) - side(all_bad)).otherwise(0.0)


def cost_benefit(revenue: Column, loss: Column, lift: float, share: float) -> Column:
    """Gain of a model over another: the loss it avoids at one approval share less the revenue it gives up."""
    return (loss * (lift - 1) * share) - revenue * (1 - share)
