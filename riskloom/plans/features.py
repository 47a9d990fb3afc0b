"""Feature specifications expanded into one fused aggregation per grain.

A configuration names the entity, the event time and its reference time, and lists simple aggregates, ratios and
time-since features over time ranges, segments and predicates. All of them become conditional aggregates of a single
group-by, so the events are scanned and shuffled once however many features there are.
"""

from __future__ import annotations

import datetime
import itertools
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import aggregates, times
from riskloom.functions.expressions import fill_ratio
from riskloom.operators.cumulative import same
from riskloom.plans import predicates
from riskloom.sources.shared import Batches, fingerprint

#: Features from which a plan goes by condition: as so many conditional aggregates are more code than is compiled.
WIDE = 100
_SYMBOLS = {"==": "EQ", ">=": "GE", "<=": "LE", "!=": "NE", ">": "GT", "<": "LT", "&": "AND", "|": "OR", "/": "DIV", "*": "MUL", "+": "PLUS", "-": "MINUS"}


def clean_name(name: str, limit: int | None = None) -> str:
    """Operators by words, all else but letters, digits and _ dropped, upper case, cut to ``limit``."""
    for symbol, word in _SYMBOLS.items():
        name = name.replace(symbol, f"_{word}_")
    name = re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_]", "_", name)).strip("_").upper()
    return name[:limit] if limit else name


@dataclass(frozen=True)
class Entity:
    """Roles: id, event time, reference time (a column or a naive time), unit of ranges."""

    id: str
    time: str
    reference: str | Column | datetime.datetime
    unit: str = "days"

    def age(self) -> Column:
        """Units back from the reference: 1 is the last unit."""
        return times.order_units(F.col(self.time), self.end(), self.unit)

    def end(self) -> Column:
        if isinstance(self.reference, datetime.datetime):
            return F.lit(self.reference).cast("timestamp_ntz")
        return F.col(self.reference) if isinstance(self.reference, str) else self.reference


@dataclass(frozen=True)
class Simple:
    """func of column over ages low..high (both inclusive; None: to the oldest), in one segment, under a predicate."""

    column: str
    func: str
    low: int = 1
    high: int | None = None
    segment: tuple[str, object] | None = None
    query: str | None = None
    suffix: str = ""

    @property
    def name(self) -> str:
        to = "INF" if self.high is None else str(self.high)
        parts = [self.func, self.column, str(self.low), to, *(map(str, self.segment) if self.segment else ()), self.query or "", self.suffix]
        return clean_name("_".join(p for p in parts if p))

    def within(self) -> Column:
        """The ages."""
        return F.expr(f"_age >= {self.low:d}" + ("" if self.high is None else f" AND _age <= {self.high:d}"))

    def among(self) -> Column:
        """The segment and the predicate."""
        out = predicates.segment(*self.segment) if self.segment else F.lit(True)
        return out & predicates.condition(self.query) if self.query else out

    def inside(self) -> Column:
        return self.within() & self.among() if self.segment or self.query else self.within()

    def column_of(self, entity: Entity) -> Column:
        return aggregates.aggregate(self.func, F.when(self.inside(), F.col(self.column)), F.struct(F.col(entity.time), F.col(self.column)))


@dataclass(frozen=True)
class Ratio:
    above: Simple
    below: Simple
    nan: float | None = None
    inf: float | None = None

    @property
    def name(self) -> str:
        return f"{self.above.name}_DIV_{self.below.name}"


@dataclass(frozen=True)
class TimeSince:
    """Whole units from the first or last event under a predicate to the reference."""

    which: str  # "first" or "last"
    unit: str = "days"
    query: str | None = None
    keyword: str = "TIMESINCE"

    @property
    def name(self) -> str:
        return clean_name("_".join(p for p in (self.keyword, self.which[0], self.query or "", self.unit) if p))

    def column_of(self, entity: Entity) -> Column:
        back = F.when(predicates.condition(self.query), times.whole_units(F.col(entity.time), entity.end(), self.unit))
        return F.max(back) if self.which == "first" else F.min(back)


@dataclass
class Plan:
    entity: Entity
    simple: list[Simple] = field(default_factory=list)
    ratios: list[Ratio] = field(default_factory=list)
    since: list[TimeSince] = field(default_factory=list)
    history: int | None = None  # ages above it are dropped
    count: str | None = None  # name of a column with the rows of an entity

    def needed(self) -> dict[str, Column]:
        parts = [*self.simple, *(s for r in self.ratios for s in (r.above, r.below)), *self.since]
        return {p.name: p.column_of(self.entity) for p in parts}


def validate(plan: Plan, events: DataFrame) -> list[str]:
    """Names of parts that refer to missing columns or to bad ranges."""
    bad = []
    for p in [*plan.simple, *(s for r in plan.ratios for s in (r.above, r.below))]:
        if p.column not in events.columns or (p.segment and p.segment[0] not in events.columns) or (p.high is not None and p.high < p.low):
            bad.append(p.name)
    return bad


#: Bytes of a feature's value by its type; others are counted as text of their own length.
WIDTHS = {"tinyint": 1, "smallint": 2, "int": 4, "date": 4, "float": 4, "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}


def cost(plan: Plan, events: DataFrame) -> DataFrame:
    """column, n_features, bytes: a rough upper estimate of what the plan's features take, one value an entity each."""
    made: dict[str, int] = {}
    for p in plan.simple:
        made[p.column] = made.get(p.column, 0) + 1
    kinds = dict(events.dtypes)
    width = lambda c: F.lit(float(WIDTHS[kinds[c]])) if kinds[c] in WIDTHS else F.avg(F.octet_length(F.col(c).cast("string")))
    stats = events.agg(F.count_distinct(plan.entity.id).alias("_n"), *[F.coalesce(width(c), F.lit(0.0)).alias(c) for c in made])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(n).alias("n_features"), (F.col(c) * n * F.col("_n")).alias("bytes")) for c, n in made.items()]
    return stats.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def expand(columns: Sequence[str], funcs: Sequence[str], ranges: Sequence[tuple[int, int | None]], segments: Iterable[tuple[str, object] | None] = (None,), queries: Iterable[str | None] = (None,)) -> list[Simple]:
    """All combinations, each once."""
    every = [Simple(c, f, lo, hi, s, q) for c, f, (lo, hi), s, q in itertools.product(columns, funcs, ranges, list(segments), list(queries))]
    return list(dict.fromkeys(every))


def segments_of(events: DataFrame, column: str, most: int = 100) -> list[tuple[str, object]]:
    """The distinct values of a column as segments; more than ``most`` are refused, so the driver's list stays short."""
    values = [r[0] for r in events.select(column).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values")
    return [(column, v) for v in sorted((v for v in values if v is not None))] + ([(column, None)] if None in values else [])


def build(events: DataFrame, plan: Plan, ids: DataFrame | None = None) -> DataFrame:
    """One row per entity with all features; entities of ``ids`` without events get nulls.

    Events after the reference time are dropped, so are those older than the plan's history.
    """
    if bad := validate(plan, events):
        raise ValueError(f"parts that do not fit the table: {bad}")
    e = plan.entity
    rows = events.where(F.col(e.time) <= e.end()).withColumn("_age", e.age())
    if plan.history is not None:
        rows = rows.where(F.col("_age") <= plan.history)
    if len(plan.simple) + 2 * len(plan.ratios) > WIDE:
        out = _by_condition(rows, plan)
    else:
        wanted = list(plan.needed().items()) + ([(plan.count, F.count("*"))] if plan.count else [])
        out = rows.groupBy(e.id).agg(*[c.alias(n) for n, c in wanted or [("_none", F.count("*"))]])
    for r in plan.ratios:
        out = out.withColumn(r.name, fill_ratio(F.col(r.above.name), F.col(r.below.name), r.nan, r.inf))
    keep = [p.name for p in (*plan.simple, *plan.ratios, *plan.since)] + ([plan.count] if plan.count else [])
    wanted = [e.id, *dict.fromkeys(keep)]
    out = out if out.columns == wanted else out.select(*wanted)
    return ids.select(e.id).distinct().join(out, e.id, "left") if ids is not None else out


def _by_condition(rows: DataFrame, plan: Plan) -> DataFrame:
    """The same features of many parts: each event goes to the conditions it meets, and an entity's few aggregates of each
    condition are then laid out as columns. One scan; partial aggregates of (entity, condition) come before the shuffle.

    A condition is a segment and a predicate, so an event goes to few of them, and the aggregates are those of the ranges. Where
    these are too many to be compiled, the range is a part of the condition.
    """
    e = plan.entity
    parts = list({p.name: p for p in (*plan.simple, *(s for r in plan.ratios for s in (r.above, r.below)))}.values())
    if len({(p.low, p.high, p.column, p.func) for p in parts}) <= WIDE:
        condition, value = (lambda p: (p.segment, p.query)), (lambda p: (p.column, p.func, p.low, p.high))
        fits = Simple.among
        inside = {k: F.when(p.within(), F.col(p.column)) for k, p in {(p.low, p.high, p.column): p for p in parts}.items()}
        seen = lambda p: inside[p.low, p.high, p.column]
    else:
        condition, value = (lambda p: (p.segment, p.query, p.low, p.high)), (lambda p: (p.column, p.func))
        fits, seen = Simple.inside, (lambda p: F.col(p.column))
    conditions, values = {}, {}
    for p in parts:
        conditions.setdefault(condition(p), p)
        values.setdefault(value(p), p)
    place, number = ({k: i for i, k in enumerate(d)} for d in (conditions, values))
    others = [(p.name, p.column_of(e)) for p in plan.since] + ([(plan.count, F.count("*"))] if plan.count else [])
    # One condition that every event meets: if no part has it, it is added, so that no entity is lost.
    every = place.get((None, None), -1)
    met = F.filter(F.array(F.lit(every), *[F.when(fits(p), F.lit(i)) for i, p in enumerate(conditions.values()) if i != every]), lambda k: k.isNotNull())
    order = lambda p: F.struct(F.col(e.time), F.col(p.column)) if p.func in aggregates.ORDERED else None
    made = [aggregates.aggregate(p.func, seen(p), order(p)).alias(f"_v{j}") for j, p in enumerate(values.values())]
    each = rows.withColumn("_k", F.explode(met)).groupBy(e.id, "_k").agg(*made, *[c.alias(f"_o{j}") for j, (_, c) in enumerate(others)])
    held = F.map_from_entries(F.collect_list(F.struct("_k", F.struct(*[f"_v{j}" for j in range(len(values))]))))
    out = each.groupBy(e.id).agg(held.alias("_m"), *[F.max(F.when(F.col("_k") == every, F.col(f"_o{j}"))).alias(n) for j, (n, _) in enumerate(others)])
    out = out.withColumn("_m", F.transform(F.sequence(F.lit(0), F.lit(len(conditions) - 1)), lambda k: F.try_element_at("_m", k)))

    def one(p: Simple) -> str:
        found = f"_m[{place[condition(p)]}]._v{number[value(p)]}"
        return f"coalesce({found}, 0L) AS `{p.name}`" if p.func in ("count", "nunique") else f"{found} AS `{p.name}`"

    return out.selectExpr(f"`{e.id}`", *map(one, parts), *[f"`{n}`" for n, _ in others])


def build_in_batches(events: DataFrame, plan: Plan, at: str, version: str, ids: DataFrame | None = None, size: int = WIDE) -> DataFrame:
    """``build`` in batches of ``size`` parts, each written under the folder ``at``, which all executors share.

    A batch is known by its parts and by ``version``, the caller's name for the state of the events. A run that was cut off
    goes on after the last whole batch; batches that a changed plan has in common with an earlier one are not made again, and
    another version makes all of them. The result is the batches' join by entity, null entities too.
    """
    if bad := validate(plan, events):
        raise ValueError(f"parts that do not fit the table: {bad}")
    e, made = plan.entity, Batches(events.sparkSession, at)
    parts = [*plan.simple, *plan.ratios, *plan.since]
    out = None
    for i in range(0, max(1, len(parts)), size):
        own = parts[i : i + size]
        kind = lambda t: [p for p in own if isinstance(p, t)]  # noqa: B023, E731
        batch = Plan(e, kind(Simple), kind(Ratio), kind(TimeSince), plan.history, plan.count if i == 0 else None)
        name = f"batch-{fingerprint(e.id, e.time, e.end(), e.unit, plan.history, batch.count, *own)}"
        done = made.do(name, version, lambda batch=batch: build(events, batch))
        out = done if out is None else same(out, done, [e.id])
    return ids.select(e.id).distinct().join(out, e.id, "left") if ids is not None else out


def prune(features: DataFrame, key: str, least_fill: float) -> DataFrame:
    """Without the features that are filled for less than this share of entities; one aggregation decides."""
    names = [c for c in features.columns if c != key]
    share = features.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in names]).first()
    return features.select(key, *[c for c in names if (share[c] or 0.0) >= least_fill])


def from_config(config: dict, events: DataFrame) -> Plan:
    """The plan of a configuration with the parts meta, simple, ratio and time_since."""
    meta = config["meta"]
    entity = Entity(meta["id"], meta["time"], meta["reference"], meta.get("unit", "days"))

    def simples(part: dict) -> list[Simple]:
        segs: list = [None]
        for column in part.get("segments", ()):
            segs += segments_of(events, column)
        return expand(part["columns"], part["funcs"], [tuple(r) for r in part["ranges"]], segs, part.get("queries") or [None])

    plan = Plan(entity, history=meta.get("history"), count=meta.get("count"))
    for part in config.get("simple", ()):
        plan.simple += simples(part)
    for part in config.get("ratio", ()):
        plan.ratios += [Ratio(a, b, part.get("nan_value"), part.get("inf_value")) for a, b in itertools.product(simples(part["above"]), simples(part["below"])) if a != b]
    for part in config.get("time_since", ()):
        plan.since += [TimeSince(w, u, q) for w, u, q in itertools.product(part["which"], part.get("units", ["days"]), part.get("queries") or [None])]
    return plan


def sql_text(plan: Plan, table: str) -> str:
    """The simple aggregates as one SQL statement over a table with a column _age."""
    def one(p: Simple) -> str:
        cond = [f"_age >= {p.low}"] + ([f"_age <= {p.high}"] if p.high is not None else [])
        if p.segment:
            cond.append(f"{p.segment[0]} IS NULL" if p.segment[1] is None else f"{p.segment[0]} = '{p.segment[1]}'")
        if p.query:
            cond.append(f"({predicates.to_sql(p.query)})")
        func = {"mean": "avg", "std": "stddev_samp", "var": "var_samp"}.get(p.func, p.func)
        inner = f"CASE WHEN {' AND '.join(cond)} THEN {p.column} END"
        return (f"count(DISTINCT {inner})" if func == "nunique" else f"{func}({inner})") + f" AS {p.name}"

    return f"SELECT {plan.entity.id}, " + ", ".join(one(p) for p in plan.simple) + f" FROM {table} GROUP BY {plan.entity.id}"
