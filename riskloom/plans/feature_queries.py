"""Queries over transactions: fused features, slices, categorical features, runs, times."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions import aggregates, expressions, times
from riskloom.operators import categorical, runs, slices
from riskloom.plans import features, predicates
from riskloom.plans.catalogue import register, table

LAST = datetime.datetime(2001, 9, 30)
SQL_END = "TIMESTAMP '2001-09-30'"
ENTITY = features.Entity("o_custkey", "o_orderdate", LAST, "months")
AGE = f"(datesub('month', o_orderdate, {SQL_END}) + 1)"
EVENT_LAST = datetime.datetime(2024, 2, 1)
SQL_EVENT_END = "TIMESTAMP '2024-02-01'"
PRIORITIES = ("1-URGENT", "5-LOW")


def at(when: datetime.datetime):
    """A naive time as a literal."""
    return F.lit(when).cast("timestamp_ntz")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def flagship_plan() -> features.Plan:
    segments = [None, *(("o_orderpriority", p) for p in PRIORITIES)]
    simple = features.expand(["o_totalprice"], ["mean", "sum", "max"], [(1, 3), (1, 12), (1, None)], segments)
    ratio = features.Ratio(features.Simple("o_totalprice", "sum", 1, 3), features.Simple("o_totalprice", "sum", 4, 12))
    return features.Plan(ENTITY, simple, [ratio], [features.TimeSince("last"), features.TimeSince("first", "months", "o_orderstatus == 'F'")], count="ORIG_ROWS_COUNT")


def _flagship_sql() -> tuple[str, str]:
    plan, out, floats = flagship_plan(), [], []
    for p in plan.simple:
        cond = [f"age >= {p.low}"] + ([f"age <= {p.high}"] if p.high else []) + ([f"o_orderpriority = '{p.segment[1]}'"] if p.segment else [])
        out.append(f"{'avg' if p.func == 'mean' else p.func}(CASE WHEN {' AND '.join(cond)} THEN o_totalprice END) AS {p.name}")
        floats.append(p.name)
    r = plan.ratios[0]
    floats.append(r.name)
    out.append(f"sum(CASE WHEN age BETWEEN 1 AND 3 THEN o_totalprice END) / nullif(sum(CASE WHEN age BETWEEN 4 AND 12 THEN o_totalprice END), 0) AS {r.name}")
    out.append(f"min(datediff('day', o_orderdate, {SQL_END})) AS {plan.since[0].name}")
    out.append(f"max(CASE WHEN o_orderstatus = 'F' THEN age - 1 END) AS {plan.since[1].name}")
    return f"SELECT o_custkey, {', '.join(out)}, count(*) AS ORIG_ROWS_COUNT FROM (SELECT *, {AGE} AS age FROM orders WHERE o_orderdate <= {SQL_END}) GROUP BY o_custkey", " ".join(floats)


register("A01_A02_features_fused", lambda s, d: features.build(orders(s, d), flagship_plan()), *_flagship_sql())


def config_features(s: SparkSession, d: str) -> DataFrame:
    config = {
        "meta": {"id": "o_custkey", "time": "o_orderdate", "reference": LAST, "unit": "months", "history": 24},
        "simple": [{"columns": ["o_totalprice"], "funcs": ["count", "nunique"], "ranges": [(1, 12)], "segments": ["o_orderstatus"], "queries": ["o_totalprice > 100000"]}],
        "ratio": [{"above": {"columns": ["o_totalprice"], "funcs": ["max"], "ranges": [(1, 6)]}, "below": {"columns": ["o_totalprice"], "funcs": ["max"], "ranges": [(1, 24)]}, "nan_value": -1}],
        "time_since": [{"which": ["first", "last"], "units": ["weeks"]}],
    }
    rows = orders(s, d)
    out = features.build(rows, features.from_config(config, rows), table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey")))
    return out.select("o_custkey", F.col(out.columns[1]).alias("n_all"), F.col(out.columns[2]).alias("n_f"), F.col([c for c in out.columns if "DIV" in c][0]).alias("max_ratio"), F.col("TIMESINCE_F_WEEKS").alias("first_weeks"), F.col("TIMESINCE_L_WEEKS").alias("last_weeks"))


register(
    "P01_P03_F19_config_api",
    config_features,
    f"""SELECT c_custkey AS o_custkey, n_all, n_f, max_ratio, first_weeks, last_weeks FROM customer LEFT JOIN (SELECT o_custkey,
    count(CASE WHEN age <= 12 AND o_totalprice > 100000 THEN 1 END) AS n_all, count(CASE WHEN age <= 12 AND o_totalprice > 100000 AND o_orderstatus = 'F' THEN 1 END) AS n_f,
    coalesce(max(CASE WHEN age <= 6 THEN o_totalprice END) / max(o_totalprice), -1) AS max_ratio,
    max(datediff('day', o_orderdate, {SQL_END}) // 7) AS first_weeks, min(datediff('day', o_orderdate, {SQL_END}) // 7) AS last_weeks
    FROM (SELECT *, {AGE} AS age FROM orders) WHERE age BETWEEN 1 AND 24 GROUP BY o_custkey) ON c_custkey = o_custkey""",
    "max_ratio",
)

_FUNCS = ("min", "max", "mean", "sum", "std", "var", "count", "skew", "median", "mad", "nunique")
register(
    "A10_A14_A18_aggregates_by_name",
    lambda s, d: events(s, d).groupBy("user_id").agg(*[aggregates.aggregate(f, F.col("value")).alias(f"value_{f}") for f in _FUNCS]),
    """SELECT user_id, min(value) AS value_min, max(value) AS value_max, avg(value) AS value_mean, sum(value) AS value_sum, stddev_samp(value) AS value_std, var_samp(value) AS value_var,
    count(value) AS value_count, skewness(value) AS value_skew, median(value) AS value_median, avg(abs(value - mu)) AS value_mad, count(DISTINCT value) AS value_nunique
    FROM (SELECT *, avg(value) OVER (PARTITION BY user_id) AS mu FROM events) GROUP BY user_id""",
    " ".join(f"value_{f}" for f in ("min", "max", "mean", "sum", "std", "var", "skew", "median", "mad")),
)
register(
    "A15_A19_A20_A25_categorical",
    lambda s, d: categorical.simple(events(s, d), ["user_id"], "event_type", "ts", "value"),
    """WITH m AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY user_id, event_type),
    f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS b,
      row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_type) AS c, row_number() OVER (PARTITION BY user_id ORDER BY value, event_type) AS e FROM events)
    SELECT user_id, max(CASE WHEN m.r = 1 THEN m.event_type END) AS EVENT_TYPE_MODE, max(n) AS EVENT_TYPE_NUNIQUE, max(f1) AS EVENT_TYPE_FIRST, max(l1) AS EVENT_TYPE_LAST, max(x1) AS EVENT_TYPE_ARGMAX, max(y1) AS EVENT_TYPE_ARGMIN
    FROM m JOIN (SELECT user_id, count(DISTINCT event_type) AS n, max(CASE WHEN a = 1 THEN event_type END) AS f1, max(CASE WHEN b = 1 THEN event_type END) AS l1, max(CASE WHEN c = 1 THEN event_type END) AS x1, max(CASE WHEN e = 1 THEN event_type END) AS y1 FROM f GROUP BY user_id) USING (user_id) GROUP BY user_id""",
)
register(
    "A26_A29_argmax_of_totals",
    lambda s, d: categorical.by_total(orders(s, d), ["o_custkey"], "o_orderpriority", "o_totalprice"),
    """WITH t AS (SELECT o_custkey, o_orderpriority AS c, round(sum(o_totalprice), 4) AS s, round(avg(o_totalprice), 4) AS a FROM orders GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY s DESC, c) AS r1, row_number() OVER (PARTITION BY o_custkey ORDER BY s, c) AS r2, row_number() OVER (PARTITION BY o_custkey ORDER BY a DESC, c) AS r3, row_number() OVER (PARTITION BY o_custkey ORDER BY a, c) AS r4 FROM t)
    SELECT o_custkey, max(CASE WHEN r1 = 1 THEN c END) AS O_ORDERPRIORITY_ARGMAXSUM, max(CASE WHEN r2 = 1 THEN c END) AS O_ORDERPRIORITY_ARGMINSUM, max(CASE WHEN r3 = 1 THEN c END) AS O_ORDERPRIORITY_ARGMAXMEAN, max(CASE WHEN r4 = 1 THEN c END) AS O_ORDERPRIORITY_ARGMINMEAN FROM r GROUP BY o_custkey""",
)
register(
    "A30_A31_W05_changes",
    lambda s, d: categorical.changes(events(s, d), ["user_id"], "event_type", "ts", at(EVENT_LAST), "hours", ("event_id",)),
    f"""SELECT user_id, CAST(sum(CASE WHEN moved THEN 1 ELSE 0 END) AS BIGINT) AS EVENT_TYPE_NCHANGES, min(CASE WHEN moved THEN datesub('hour', ts, {SQL_EVENT_END}) END) AS EVENT_TYPE_TSCHANGE
    FROM (SELECT *, event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS moved FROM events) GROUP BY user_id""",
)
register(
    "A16_mode_multicolumn",
    lambda s, d: categorical.modes(events(s, d), "user_id", "event_type", 3).withColumn("event_type_modes", F.array_join("event_type_modes", ",")),
    """SELECT user_id, l[1] AS event_type_mode_0, l[2] AS event_type_mode_1, l[3] AS event_type_mode_2, array_to_string(l, ',') AS event_type_modes FROM (SELECT user_id, list(event_type ORDER BY event_type) AS l
    FROM (SELECT user_id, event_type, rank() OVER (PARTITION BY user_id ORDER BY count(*) DESC) AS r FROM events GROUP BY user_id, event_type) WHERE r = 1 GROUP BY user_id)""",
)
register(
    "A17_monotonic",
    lambda s, d: categorical.monotonic(orders(s, d), "o_custkey", "o_totalprice", "o_orderdate", ("o_orderkey",)),
    """SELECT o_custkey, coalesce(bool_and(step >= 0), true) AS is_increasing, coalesce(bool_and(step <= 0), true) AS is_decreasing
    FROM (SELECT *, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step FROM orders) GROUP BY o_custkey""",
)


def _runs_sql() -> str:
    part = lambda w, h: f"""coalesce(sum(CASE WHEN {h} THEN len END), 0)::BIGINT AS sum{w}, coalesce(max(CASE WHEN {h} THEN len END), 0)::BIGINT AS max{w}, coalesce(avg(CASE WHEN {h} THEN len END), 0) AS mean{w},
    coalesce(max(CASE WHEN {h} AND run = last_run THEN len END), 0)::BIGINT AS maxcon{w}fix, sum(CASE WHEN {h} AND len > 1 THEN 1 ELSE 0 END)::BIGINT AS con{w}1, coalesce(min(CASE WHEN {h} AND len > 1 THEN n_all - ending END), 0)::BIGINT AS distcon{w}1,
    sum(CASE WHEN {h} THEN greatest(0, least(len, ending - (n_all - 3))) ELSE 0 END) / nullif(sum(CASE WHEN {h} THEN len - greatest(0, least(len, ending - (n_all - 3))) ELSE 0 END), 0) AS r3_{w}"""  # noqa: E731
    return f"""WITH a AS (SELECT user_id, ts, event_id, value > 50 AS held, CASE WHEN (value > 50) <> lag(value > 50) OVER w THEN 1 ELSE 0 END AS flip, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, sum(flip) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a), c AS (SELECT user_id, run, held, count(*) AS len, max(n) AS ending FROM b GROUP BY ALL),
    e AS (SELECT *, max(run) OVER (PARTITION BY user_id) AS last_run, CAST(sum(len) OVER (PARTITION BY user_id) AS BIGINT) AS n_all FROM c)
    SELECT user_id, max(n_all) AS n_rows, {part("is", "held")}, {part("not", "NOT held")}, sum(CASE WHEN held THEN len ELSE 0 END) / max(n_all) AS r_sumis FROM e GROUP BY user_id"""


register("A35_A42_W06_W07_runs", lambda s, d: runs.run_features(events(s, d), "user_id", "ts", F.col("value") > 50, ties=("event_id",)), _runs_sql(), "meanis meannot r3_is r3_not r_sumis")
register(
    "A32_A34_time_since",
    lambda s, d: events(s, d).groupBy("user_id").agg(*[F.max(F.when(predicates.category("event_type", "click"), times.whole_units(F.col("ts"), at(EVENT_LAST), u))).alias(f"first_{u}") for u in ("days", "hours", "weeks")], F.min(F.when(predicates.interval("value", 10, 100, "left"), times.whole_units(F.col("ts"), at(EVENT_LAST), "minutes"))).alias("last_minutes")),
    f"""SELECT user_id, max(CASE WHEN event_type = 'click' THEN datesub('day', ts, {SQL_EVENT_END}) END) AS first_days, max(CASE WHEN event_type = 'click' THEN datesub('hour', ts, {SQL_EVENT_END}) END) AS first_hours,
    max(CASE WHEN event_type = 'click' THEN datesub('day', ts, {SQL_EVENT_END}) // 7 END) AS first_weeks, min(CASE WHEN value >= 10 AND value < 100 THEN datesub('minute', ts, {SQL_EVENT_END}) END) AS last_minutes FROM events GROUP BY user_id""",
)
register(
    "A33_segments_expanded",
    lambda s, d: features.build(events(s, d), features.Plan(features.Entity("user_id", "ts", at(EVENT_LAST), "weeks"), [features.Simple("value", "sum", 1, 2, seg) for seg in features.segments_of(events(s, d), "event_type")])).select("user_id", F.col("SUM_VALUE_1_2_EVENT_TYPE_CLICK").alias("click"), F.col("SUM_VALUE_1_2_EVENT_TYPE_ERROR").alias("error")),
    f"""SELECT user_id, sum(CASE WHEN age <= 2 AND event_type = 'click' THEN value END) AS click, sum(CASE WHEN age <= 2 AND event_type = 'error' THEN value END) AS error
    FROM (SELECT *, datesub('day', ts, {SQL_EVENT_END}) // 7 + 1 AS age FROM events) GROUP BY user_id""",
    "click error",
)
_SLICED = f"(SELECT *, {AGE} AS TIME_ORDER FROM orders WHERE o_orderdate <= {SQL_END})"
register(
    "A06_J01_J02_slices_on_grid",
    lambda s, d: slices.on_grid(slices.general(slices.assign(orders(s, d), "o_orderdate", at(LAST), "months", 24), "o_custkey", "o_totalprice", ["sum", "max"]), slices.grid(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", at(LAST), "months", 24).drop("TIME_FROM", "TIME_TO"), "o_custkey"),
    f"""SELECT c_custkey AS o_custkey, CAST(k AS INTEGER) AS TIME_ORDER, O_TOTALPRICE_SUM, O_TOTALPRICE_MAX FROM customer CROSS JOIN range(1, 25) AS r(k)
    LEFT JOIN (SELECT o_custkey, TIME_ORDER, sum(o_totalprice) AS O_TOTALPRICE_SUM, max(o_totalprice) AS O_TOTALPRICE_MAX FROM {_SLICED} GROUP BY ALL) ON c_custkey = o_custkey AND k = TIME_ORDER""",
    "O_TOTALPRICE_SUM O_TOTALPRICE_MAX",
)
register(
    "A07_A08_J05_segmented_slices",
    lambda s, d: slices.segmented(slices.assign(orders(s, d), "o_orderdate", at(LAST), "years", 5), "o_custkey", "o_totalprice", "sum", "o_orderstatus", ["F", "O"]).join(slices.segmented(slices.assign(orders(s, d), "o_orderdate", at(LAST), "years", 5), "o_custkey", "o_totalprice", "sum", "o_orderstatus", ["F"], relative=True), ["o_custkey", "TIME_ORDER"]),
    f"""SELECT o_custkey, TIME_ORDER, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS O_TOTALPRICE_O_ORDERSTATUS_F_SUM, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS O_TOTALPRICE_O_ORDERSTATUS_O_SUM,
    sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) / sum(o_totalprice) AS O_TOTALPRICE_O_ORDERSTATUS_F_SUM_R FROM (SELECT * REPLACE ((TIME_ORDER - 1) // 12 + 1 AS TIME_ORDER) FROM {_SLICED}) WHERE TIME_ORDER <= 5 GROUP BY ALL""",
    "O_TOTALPRICE_O_ORDERSTATUS_F_SUM O_TOTALPRICE_O_ORDERSTATUS_O_SUM O_TOTALPRICE_O_ORDERSTATUS_F_SUM_R",
)
register(
    "A09_categorical_slices",
    lambda s, d: categorical.simple(slices.assign(orders(s, d), "o_orderdate", at(LAST), "years", 3), ["o_custkey", "TIME_ORDER"], "o_orderpriority", "o_orderdate", "o_totalprice", ("nunique", "argmax")),
    f"""SELECT o_custkey, TIME_ORDER, count(DISTINCT o_orderpriority) AS O_ORDERPRIORITY_NUNIQUE, arg_max(o_orderpriority, o_totalprice) AS O_ORDERPRIORITY_ARGMAX FROM (SELECT * REPLACE ((TIME_ORDER - 1) // 12 + 1 AS TIME_ORDER) FROM {_SLICED}) WHERE TIME_ORDER <= 3 GROUP BY ALL""",
)
register(
    "F06_T01_slice_bounds",
    lambda s, d: slices.grid(table(s, d, "customer").select(F.col("c_custkey").alias("e")), "e", at(LAST), "months", 14),
    f"SELECT c_custkey AS e, CAST(k AS INTEGER) AS TIME_ORDER, {SQL_END} - to_months(CAST(k AS INTEGER)) AS TIME_FROM, {SQL_END} - to_months(CAST(k - 1 AS INTEGER)) AS TIME_TO FROM customer, range(1, 15) AS r(k)",
)
register(
    "W01_W03_time_order",
    lambda s, d: slices.time_order(orders(s, d), "o_custkey", "o_orderdate", ["o_orderkey"]).select("o_orderkey", "TIME_ORDER"),
    "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS TIME_ORDER FROM orders",
)
register(
    "P06_P07_T02_history_filter",
    lambda s, d: slices.assign(orders(s, d), "o_orderdate", at(datetime.datetime(2000, 2, 29)), "months", 6).select("o_orderkey", "TIME_ORDER"),
    "SELECT o_orderkey, datesub('month', o_orderdate, TIMESTAMP '2000-02-29') + 1 AS TIME_ORDER FROM orders WHERE o_orderdate <= TIMESTAMP '2000-02-29' AND datesub('month', o_orderdate, TIMESTAMP '2000-02-29') + 1 <= 6",
)
register(
    "F01_F05_F27_time_differences",
    lambda s, d: orders(s, d).where(F.col("o_orderdate") <= at(LAST)).select("o_orderkey", times.difference(F.col("o_orderdate"), at(LAST), "weeks").alias("weeks"), times.difference(F.col("o_orderdate"), at(LAST), "days", "floor").cast("long").alias("days"), times.months_by_day(F.col("o_orderdate"), at(LAST)).cast("long").alias("months_by_day"), times.whole_units(F.col("o_orderdate"), at(LAST), "months").alias("whole_months"), times.whole_units(F.col("o_orderdate"), at(LAST), "years").alias("whole_years"), times.difference(F.col("o_orderdate"), at(LAST), "years").alias("years"), times.yyyymm(F.col("o_orderdate")).alias("ym")),
    f"""SELECT o_orderkey, epoch({SQL_END} - o_orderdate) / 604800 AS weeks, datediff('day', o_orderdate, {SQL_END}) AS days, 12 * (2001 - year(o_orderdate)) + 9 - month(o_orderdate) - (CASE WHEN 30 <= day(o_orderdate) THEN 1 ELSE 0 END) + 1 AS months_by_day,
    datesub('month', o_orderdate, {SQL_END}) AS whole_months, datesub('year', o_orderdate, {SQL_END}) AS whole_years, epoch({SQL_END} - o_orderdate) / 31556952 AS years, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS ym FROM orders WHERE o_orderdate <= {SQL_END}""",
    "weeks years",
)
register(
    "F02_y2k",
    lambda s, d: orders(s, d).select("o_orderkey", times.fix_y2k(F.col("o_orderdate"), at(datetime.datetime(2000, 1, 1))).alias("fixed")),
    "SELECT o_orderkey, CASE WHEN o_orderdate > TIMESTAMP '2000-01-01' THEN o_orderdate - INTERVAL 36525 DAY ELSE o_orderdate END AS fixed FROM orders",
)
_I = lambda k, a, b, **x: expressions.interact(k, F.col(a), F.col(b), **x).alias(f"{k}_x")
register(
    "F09_F15_interactions",
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *[_I(k, "l_quantity", "l_discount", nan=0.0, inf=999.0) for k in ("sum", "product", "difference", "ratio", "equality")], expressions.interact("cartesian", F.col("l_returnflag"), F.nullif(F.col("l_linestatus"), F.lit("O"))).alias("cartesian_x")),
    """SELECT l_orderkey, l_linenumber, l_quantity + l_discount AS sum_x, l_quantity * l_discount AS product_x, l_quantity - l_discount AS difference_x, CASE WHEN l_discount = 0 THEN sign(l_quantity) * 999.0 ELSE l_quantity / l_discount END AS ratio_x,
    CASE WHEN l_quantity < l_discount THEN '<' WHEN l_quantity = l_discount THEN '=' ELSE '>' END AS equality_x, l_returnflag || '_' || coalesce(nullif(l_linestatus, 'O'), 'NaN') AS cartesian_x FROM lineitem""",
    "sum_x product_x difference_x ratio_x",
)
register(
    "F16_F17_F20_F21_scalars",
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", expressions.logit(F.col("l_discount")).alias("logit"), expressions.expit(F.col("l_tax")).alias("expit"), expressions.text_length(F.nullif(F.col("l_returnflag"), F.lit("N"))).alias("length"), expressions.bin_index(F.col("l_quantity"), [10, 20, 40], "right").alias("bin")),
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN ln(l_discount / (1 - l_discount)) END AS logit, 1 / (1 + exp(-l_tax)) AS expit, CAST(length(coalesce(nullif(l_returnflag, 'N'), '')) AS BIGINT) AS length,
    CAST(l_quantity > 10 AS INTEGER) + CAST(l_quantity > 20 AS INTEGER) + CAST(l_quantity > 40 AS INTEGER) AS bin FROM lineitem""",
    "logit expit",
)
register(
    "P08_predicates",
    lambda s, d: events(s, d).where(predicates.condition("value > 10 & value <= 50 & event_type == 'click'") | predicates.interval("value", 100, None, "neither")).select("event_id"),
    "SELECT event_id FROM events WHERE (value > 10 AND value <= 50 AND event_type = 'click') OR value > 100",
)
register(
    "W04_first_last_value",
    lambda s, d: events(s, d).select("event_id", *[f("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(n) for f, n in ((F.first, "first_value"), (F.last, "last_value"))]),
    "SELECT event_id, first_value(value) OVER w AS first_value, last_value(value) OVER w AS last_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
)
register(
    "W13_W17_running_mean",
    lambda s, d: events(s, d).select("event_id", F.avg("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("mean_so_far")),
    "SELECT event_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mean_so_far FROM events",
    "mean_so_far",
)


def wide_plan() -> features.Plan:
    """450 features of one grain."""
    ranges = [(1, k) for k in (1, 2, 3, 4, 6, 9, 12, 18, 24, 30, 36, 48, 60, 72)] + [(1, None)]
    segments = [None, *(("o_orderpriority", p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))]
    return features.Plan(ENTITY, features.expand(["o_totalprice"], ["mean", "sum", "max", "min", "count"], ranges, segments))


_WIDE = wide_plan()
register(
    "A01_A03_features_450",
    lambda s, d: features.build(orders(s, d), _WIDE),
    f"WITH e AS (SELECT *, {AGE} AS _age FROM orders WHERE o_orderdate <= {SQL_END}) {features.sql_text(_WIDE, 'e')}",
    " ".join(p.name for p in _WIDE.simple if p.func != "count"),
)
