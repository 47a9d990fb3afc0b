"""Aggregates by name: the whitelist from which specifications pick, each as one Catalyst expression."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def skew(c: Column) -> Column:
    """Bias-corrected skewness; null below three values."""
    n = F.count(c).cast("double")
    return F.when((n >= 3) & (F.var_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)).when(n >= 3, 0.0)


def mad(c: Column) -> Column:
    """Mean absolute deviation from the mean, over the group's values."""
    values = F.collect_list(c)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + F.abs(x - mean)) / F.size(values))


#: Aggregates of one column; nulls take no part and no value gives null (0 for nunique).
BY_NAME: dict[str, Callable[[Column], Column]] = {
    "min": F.min,
    "max": F.max,
    "mean": lambda c: F.avg(c.cast("double")),
    "sum": F.sum,
    "std": lambda c: F.stddev_samp(c.cast("double")),
    "var": lambda c: F.var_samp(c.cast("double")),
    "count": F.count,
    "skew": lambda c: skew(c.cast("double")),
    "median": lambda c: F.median(c),
    "mad": lambda c: mad(c.cast("double")),
    "mode": lambda c: F.mode(c, True),
    "nunique": F.countDistinct,
}
#: Aggregates that need an order.
ORDERED: dict[str, Callable[[Column, Column], Column]] = {
    "first": lambda c, order: F.min_by(c, F.when(c.isNotNull(), order)),
    "last": lambda c, order: F.max_by(c, F.when(c.isNotNull(), order)),
}
NUMERIC = frozenset(BY_NAME) - {"mode", "nunique"}
#: Aggregates that make sense for each kind of column.
OFFERED: dict[str, frozenset[str]] = {
    "numeric": frozenset(BY_NAME) | frozenset(ORDERED),
    "categorical": frozenset({"count", "mode", "nunique", *ORDERED}),
    "time": frozenset({"count", "min", "max", "nunique", *ORDERED}),
}


def aggregate(name: str, c: Column, order: Column | None = None) -> Column:
    if name in ORDERED:
        if order is None:
            raise ValueError(f"{name} needs an order column")
        return ORDERED[name](c, order)
    if name not in BY_NAME:
        raise ValueError(f"unknown aggregate {name!r}; known: {sorted(BY_NAME) + sorted(ORDERED)}")
    return BY_NAME[name](c)


def best(value: Column, metric: Column, largest: bool) -> Column:
    """The value at the largest or smallest metric; of ties the smallest value. Null metrics and values take no part."""
    fits = value.isNotNull() & metric.isNotNull()
    key = -metric if largest else metric
    return F.min(F.when(fits, F.struct(key.alias("k"), value.alias("v"))))["v"]


@dataclass(frozen=True)
class Declared:
    """An aggregate of one's own, declared in three steps that Spark runs as two group-bys.

    ``partial`` gives named aggregates of a part of a group's values, ``merge`` says how each of them is put together over the
    parts, and ``finish`` makes the value from the merged ones. Parts are by a salt, so a group that holds most rows is spread.
    """

    partial: Mapping[str, Callable[[Column], Column]]
    merge: Mapping[str, Callable[[Column], Column]]
    finish: Callable[[Mapping[str, Column]], Column]


class Registry:
    """Aggregates by name: those of the library, and declared ones, which are checked when they are added."""

    def __init__(self) -> None:
        self.declared: dict[str, Declared] = {}

    def add(self, name: str, one: Declared) -> None:
        """Refuses names that are taken or no identifiers, and steps that do not fit together. Nothing is evaluated from text."""
        if not name.isidentifier() or name in BY_NAME or name in ORDERED or name in self.declared:
            raise ValueError(f"{name!r} is taken or no name")
        if not one.partial or set(one.partial) != set(one.merge):
            raise ValueError(f"{name}: partial and merge name different values: {sorted(one.partial)}, {sorted(one.merge)}")
        merged = {k: one.merge[k](one.partial[k](F.col("x"))) for k in one.partial}
        if not isinstance(one.finish(merged), Column) or not all(isinstance(c, Column) for c in merged.values()):
            raise TypeError(f"{name}: a step gives no Column")
        self.declared[name] = one

    def prove(self, rows: DataFrame, column: str, name: str, parts: int = 7, within: float = 1e-9) -> None:
        """Raises unless the value over many parts of ``rows`` is the value over one: the steps are then a true merge."""
        one, many = (self.group(rows, (), {"v": (name, column)}, salts=n).first()["v"] for n in (1, parts))
        if one != many and not (one is not None and many is not None and abs(one - many) <= within * max(1.0, abs(one))):
            raise ValueError(f"{name}: {many} over {parts} parts, {one} over one")

    def group(self, rows: DataFrame, by: Sequence[str], made: Mapping[str, tuple[str, str]], salts: int = 16, order: Column | None = None) -> DataFrame:
        """by, and each output with its (aggregate, column). Declared ones share two group-bys, the others one.

        Null groups stay. A group's parts are by a hash of the row's columns, so reruns agree; nulls go to the steps as they are.
        """
        plain = {n: a for n, a in made.items() if a[0] not in self.declared}
        own = {n: a for n, a in made.items() if a[0] in self.declared}
        out = None
        if plain or not own:
            out = rows.groupBy(*by).agg(*[aggregate(f, F.col(c), order).alias(n) for n, (f, c) in plain.items()] or [F.count("*").alias("n")])
        if own:
            salt = F.pmod(F.xxhash64(*dict.fromkeys(c for _, c in own.values())), F.lit(salts))
            values = [(n, k, c, self.declared[f]) for n, (f, c) in own.items() for k in self.declared[f].partial]
            parts = rows.withColumn("_salt", salt).groupBy(*by, "_salt").agg(*[d.partial[k](F.col(c)).alias(f"_{n}_{k}") for n, k, c, d in values])
            whole = parts.groupBy(*by).agg(*[d.merge[k](F.col(f"_{n}_{k}")).alias(f"_{n}_{k}") for n, k, _, d in values])
            done = whole.select(*by, *[self.declared[f].finish({k: F.col(f"_{n}_{k}") for k in self.declared[f].partial}).alias(n) for n, (f, _) in own.items()])
            if out is None:
                out = done
            else:
                right = done.select(*[F.col(b).alias(f"_by_{b}") for b in by], *own)
                on = F.lit(True)
                for b in by:
                    on = on & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
                out = out.join(right, on) if by else out.crossJoin(F.broadcast(right))  # one row on each side
        return out.select(*by, *made)
