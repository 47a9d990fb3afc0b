"""Queries over neighbours, boosted trees, declared aggregates, resamples, text twins, and jobs that go in parts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import aggregates
from riskloom.operators import binning, boosting, categorical, comparison, metrics, models, neighbours, reports, sampling
from riskloom.plans import features
from riskloom.plans.catalogue import register, table
from riskloom.plans.feature_queries import AGE, ENTITY, SQL_END, orders
from riskloom.plans.measure_queries import POP, gini_sql, population
from riskloom.plans.model_queries import facts
from riskloom.sources import imports, tables
from riskloom.sources.shared import folder
from riskloom.streaming import events as streams

COLUMNS = ["l_quantity", "l_discount", "l_extendedprice"]


def both_sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers by nation and balance; whole numbers, so that distances are exact in any engine."""
    c = table(s, d, "customer").select("c_custkey", (F.col("c_nationkey") * 10_000).cast("double").alias("nation"), F.round(F.col("c_acctbal") * 100).alias("cents"))
    p = table(s, d, "supplier").select((F.col("s_nationkey") * 10_000).cast("double").alias("nation"), F.round(F.col("s_acctbal") * 100).alias("cents"))
    return c, p


_SQUARE = "(a.nation - b.nation) * (a.nation - b.nation) + (a.cents - b.cents) * (a.cents - b.cents)"
register(
    "J16_radius_weights",
    lambda s, d: neighbours.radius_weights(*both_sides(s, d), ["nation", "cents"], 20, normalize=False).select("c_custkey", "weight"),
    f"""WITH a AS (SELECT c_custkey, c_nationkey * 10000.0::DOUBLE AS nation, round(c_acctbal * 100) AS cents FROM customer), t AS (SELECT s_nationkey * 10000.0::DOUBLE AS nation, round(s_acctbal * 100) AS cents FROM supplier),
    r AS (SELECT c_custkey, nation, cents, d AS radius FROM (SELECT a.c_custkey, a.nation, a.cents, {_SQUARE} AS d, row_number() OVER (PARTITION BY a.c_custkey ORDER BY {_SQUARE}) AS k FROM a, a AS b) WHERE k = 20)
    SELECT a.c_custkey, count(*) FILTER (WHERE {_SQUARE} <= a.radius) AS weight FROM r AS a, t AS b GROUP BY a.c_custkey""",
)


def boosted(s: SparkSession, d: str):
    return boosting.fit(population(s, d), COLUMNS, "y", 4, 3)


register("L24_importances", lambda s, d: s.createDataFrame(boosting.importances(population(s, d), boosted(s, d), COLUMNS), "column string, importance double"))
register("L24_attributions", lambda s, d: population(s, d).select("l_orderkey", "l_linenumber", boosting.attributions(boosted(s, d), COLUMNS).alias("parts")))


def selected(s: SparkSession, d: str) -> DataFrame:
    """Columns by importance, one more at a time, with AUC across folds, on a test set and out of time."""
    rows = population(s, d)
    ranked = boosting.importances(rows, boosted(s, d), COLUMNS)
    tool = boosting.Selection(rows, "y", "l_orderkey", {"test": "l_orderkey % 5 = 0", "late": "yr >= 1998"}, folds=2, trees=4, depth=2, every=2)
    steps = tool.run(ranked, step=1, least_gain=0.0)
    return s.createDataFrame([(x.columns, x.trees, x.cv_auc, x.aucs.get("test"), x.aucs.get("late")) for x in steps], "columns array<string>, trees int, cv_auc double, test_auc double, late_auc double")


register("L11_boosted_selection", selected)


def targets(s: SparkSession, d: str) -> DataFrame:
    rows = population(s, d).withColumns({"base": F.lit(1), "rest": (F.col("l_quantity") > 10).cast("int"), "late": (F.col("yr") >= 1996).cast("int"), "fold": models.fold("l_orderkey", 4)})
    part = lambda *k: rows.where(F.col("fold").isin(*k))
    return boosting.target_matrix(part(0, 1), part(2), part(3), [("y", "base"), ("late", "rest")], COLUMNS[1:], ["seg"], trees=4, depth=2, least=1)


register("L12_target_matrix", targets)


def resumed(s: SparkSession, d: str) -> DataFrame:
    """Features in batches; the second call finds what the first has made."""
    events = orders(s, d)
    parts = features.expand(["o_totalprice"], ["sum", "max", "count"], [(1, 6), (1, None)])
    plan, at = features.Plan(ENTITY, parts), f"{folder(s)}/batches-{uuid.uuid4().hex}"
    features.build_in_batches(events, features.Plan(ENTITY, parts[:4]), at, "v1", size=2)
    out = features.build_in_batches(events, plan, at, "v1", size=2)
    return out.toDF("o_custkey", *[f"f{i}" for i in range(len(parts))])


_T03 = ", ".join(f"{f}(CASE WHEN {c} THEN o_totalprice END) AS f{2 * i + j}" for i, f in enumerate(("sum", "max", "count")) for j, c in enumerate(("age <= 6", "age >= 1")))
register("T03_resumed_features", resumed, f"SELECT o_custkey, {_T03} FROM (SELECT *, {AGE} AS age FROM orders) WHERE o_orderdate <= {SQL_END} GROUP BY o_custkey", "f0 f1 f2 f3 f4 f5")


def ranged(s: SparkSession, d: str) -> DataFrame:
    """A table by key ranges, each a part of its own; the view appears when all are there."""
    job = imports.Import(s, f"{folder(s)}/import-{uuid.uuid4().hex}")
    rows = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return job.ranges(rows, "o_orderkey", max(1, rows.count() // 4), "v1", f"imported_{uuid.uuid4().hex}")


register("S14_chunked_import", ranged, "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")


def blocks(s: SparkSession, d: str) -> DataFrame:
    """Attribute-value rows as a wide table for each block of a catalogue."""
    job = imports.Import(s, f"{folder(s)}/blocks-{uuid.uuid4().hex}")
    made = job.blocks(facts(s, d), [("status", "a_status", "text_1"), ("key", "a_key", "number_1")], "o_custkey", "attribute", "phase", ["num", "txt"], "v1")
    return made["text_1"].join(made["number_1"].select("o_custkey", F.col("a_key").cast("double").cast("long").alias("a_key")), "o_custkey")


_LAST = "(SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS m FROM orders)"
register("S09_S13_import_blocks", blocks, f"SELECT o_custkey, max(o_orderstatus) AS a_status, CAST(arg_max(o_orderkey, CAST(CAST(o_orderkey AS DOUBLE) AS VARCHAR)) AS BIGINT) AS a_key FROM {_LAST} WHERE o_orderdate = m GROUP BY o_custkey")


def _registry() -> aggregates.Registry:
    out = aggregates.Registry()
    harmonic = aggregates.Declared({"n": F.count, "s": lambda c: F.sum(1 / c.cast("double"))}, {"n": F.sum, "s": F.sum}, lambda v: v["n"] / v["s"])
    spread = aggregates.Declared({"low": F.min, "high": F.max}, {"low": F.min, "high": F.max}, lambda v: v["high"] - v["low"])
    out.add("harmonic_mean", harmonic)
    out.add("spread", spread)
    return out


register(
    "X01_X02_X03_declared_aggregates",
    lambda s, d: _registry().group(orders(s, d), ["o_orderpriority"], {"harmonic": ("harmonic_mean", "o_totalprice"), "spread": ("spread", "o_totalprice"), "mean": ("mean", "o_totalprice"), "last": ("last", "o_totalprice")}, order=F.struct("o_orderdate", "o_orderkey")),
    "SELECT o_orderpriority, count(*) / sum(1 / o_totalprice) AS harmonic, max(o_totalprice) - min(o_totalprice) AS spread, avg(o_totalprice) AS mean, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY o_orderpriority",
    "harmonic spread mean last",
)
_CATEGORICAL = ("mode", "nunique", "first", "last", "argmax", "argmin", "argmaxsum", "argminmean", "nchanges", "tschange")


def _categorical(view: str) -> str:
    return categorical.sql_text(view, "o_custkey", "o_orderpriority", _CATEGORICAL, "cents", "o_orderdate", 1, 24, ("o_orderkey",))


def categorical_twin(s: SparkSession, d: str) -> DataFrame:
    """Categorical features as SQL text, run over a view with the ages."""
    view = f"aged_{uuid.uuid4().hex}"
    aged = orders(s, d).where(F.col("o_orderdate") <= ENTITY.end()).withColumns({"_age": ENTITY.age(), "cents": F.round(F.col("o_totalprice") * 100).cast("long")})
    aged.createOrReplaceTempView(view)
    return s.sql(_categorical(view)).toDF("o_custkey", *_CATEGORICAL)


_AGED = f"WITH aged AS (SELECT *, {AGE} AS _age, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_orderdate <= {SQL_END}) "
register("J06_categorical_sql", categorical_twin, f"SELECT * FROM ({_AGED}{_categorical('aged')}) AS q(o_custkey, {', '.join(_CATEGORICAL)})")

_CARD = models.ScoreCard(
    [binning.Bins("l_quantity", edges=[10.0, 25.0, 40.0], woes=[0.5, 0.25, -0.25, -0.5]), binning.Bins("seg", groups=[["F"], ["O"]], woes=[0.75, -0.75], unknown_woe=0.1)],
    models.Logit(["l_quantity_WOE", "seg_WOE"], [-0.8, 1.2], 0.1),
)


def card_twin(s: SparkSession, d: str) -> DataFrame:
    """A scorecard with its groups as SQL text."""
    view = f"population_{uuid.uuid4().hex}"
    population(s, d).select("l_orderkey", "l_linenumber", "l_quantity", "seg").createOrReplaceTempView(view)
    return s.sql(_CARD.sql(view, groups=True))


register("L20_scorecard_sql", card_twin, _CARD.sql(f"({POP}SELECT l_orderkey, l_linenumber, l_quantity, seg FROM p) AS q", groups=True), "l_quantity l_quantity_WOE seg_WOE score")
register(
    "M17_same_distribution",
    lambda s, d: metrics.same_distribution(population(s, d).where("treated = 0"), population(s, d).where("treated = 1"), "l_quantity", 7),
    POP + """, r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, CAST(count(*) AS DOUBLE) AS n, (SELECT CAST(count(*) AS DOUBLE) FROM p WHERE treated = 1) AS m FROM p WHERE treated = 0),
    c AS (SELECT least(6, floor((l_quantity - lo) / ((hi - lo) / 7))) AS cell, sum(1 - treated) AS a, sum(treated) AS b FROM p, r WHERE l_quantity BETWEEN lo AND hi GROUP BY 1),
    x AS (SELECT sum(pow(sqrt(n / m) * b - sqrt(m / n) * a, 2) / (a + b)) AS statistic, CAST(count(*) - 1 AS INTEGER) AS df FROM c, r)
    SELECT statistic, df, exp(-statistic / 2) * (1 + statistic / 2 + statistic * statistic / 8) AS p_value FROM x""",
    "statistic p_value",
)
register("O06_resample", lambda s, d: sampling.resample(population(s, d), 3).agg(F.count("*").alias("n_different"), F.sum("draws").alias("n_draws")), POP + "SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM (SELECT l_orderkey, l_linenumber, l_discount, l_quantity, l_extendedprice, l_returnflag = 'R', l_linestatus, l_suppkey % 2, l_shipdate FROM lineitem))) AS n_different, CAST(count(*) AS BIGINT) AS n_draws FROM p")
SCORES = ("l_quantity", "l_extendedprice")
SAMPLES = {"old": "yr < 1996", "paid": "treated = 1"}


def compared(s: SparkSession, d: str) -> comparison.Comparison:
    return comparison.compare(population(s, d), SCORES, "y", "seg", SAMPLES)


#: A row for each sample, segment (or all) and score.
_Z = POP + ", z AS (" + " UNION ALL ".join(f"SELECT '{n}' AS sample, {g} AS segment, '{c}' AS score, {c} AS v, y FROM p WHERE {w}" for n, w in SAMPLES.items() for g in ("seg", "'All'") for c in SCORES) + ")"
_BY = "sample, segment, name"
register(
    "R17_M34_score_comparison",
    lambda s, d: compared(s, d).table((10,)),
    _Z.replace("AS score, ", "AS name, ")
    + f""", g AS (SELECT * FROM (WITH q AS (SELECT 1){gini_sql("v", _BY, "z")})), c AS (SELECT {_BY}, quantile_cont(v, 0.9) AS cut, count(*) AS n, sum(y) AS bads, avg(y) AS rate, avg(v) AS mean_score FROM z GROUP BY {_BY}),
    l AS (SELECT {_BY}, avg(CASE WHEN v >= cut THEN CAST(y AS DOUBLE) END) AS top FROM z JOIN c USING ({_BY}) GROUP BY {_BY})
    SELECT sample, segment, c.n, c.n AS measurable, bads, rate, name AS score, c.n AS hits, mean_score, gini, ks, top / rate AS lift_10 FROM c JOIN l USING ({_BY}) JOIN g USING ({_BY})""",
    "measurable bads rate mean_score gini ks lift_10",
)
register(
    "R17_comparison_roc",
    lambda s, d: compared(s, d).roc().where("score = 'l_quantity'"),
    _Z + ", t AS (SELECT sample, segment, v AS value, sum(y) AS b, sum(1 - y) AS g FROM z WHERE score = 'l_quantity' GROUP BY sample, segment, v) SELECT sample, segment, 'l_quantity' AS score, value, sum(g) OVER w / sum(g) OVER (PARTITION BY sample, segment) AS fpr, sum(b) OVER w / sum(b) OVER (PARTITION BY sample, segment) AS tpr FROM t WINDOW w AS (PARTITION BY sample, segment ORDER BY value DESC)",
    "value fpr tpr",
)
register(
    "A51_month_by_sample",
    lambda s, d: reports.sample_description(population(s, d).withColumn("data_type", F.when(F.col("l_orderkey") % 3 > 0, "train").otherwise("test")), ["yr", "data_type"], "y", "treated"),
    POP + "SELECT yr, CASE WHEN l_orderkey % 3 > 0 THEN 'train' ELSE 'test' END AS data_type, count(*) AS n, CAST(sum(treated) AS BIGINT) AS measurable, CAST(sum(treated * y) AS BIGINT) AS bads, sum(treated * y) / sum(treated) AS rate FROM p GROUP BY ROLLUP (yr, data_type)",
    "rate",
)
register(
    "B04_gini_of_groups",
    lambda s, d: binning.gini_of_groups(binning.bin_table(population(s, d), F.col("yr"), "y")),
    POP + ", z AS (SELECT avg(y) OVER (PARTITION BY yr) AS rate, y FROM p)" + gini_sql("rate", "", "z").replace("SELECT auc, 2 * auc - 1 AS gini, ks, n", "SELECT 2 * auc - 1 AS gini"),
    "gini",
)
_CELLS = "least(9, CAST(floor((l_extendedprice - lo) / (hi - lo) * 10) AS INTEGER))"
register(
    "M15_psi_in_time",
    lambda s, d: metrics.psi_in_time(population(s, d), "l_extendedprice", "yr", 1995, 10),
    POP + f""", e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM p WHERE yr = 1995), t AS (SELECT yr, {_CELLS} AS bin, count(*) AS n FROM p, e WHERE l_extendedprice BETWEEN lo AND hi GROUP BY ALL),
    g AS (SELECT yr, bin, coalesce(n, 0) AS n, sum(n) OVER (PARTITION BY yr) AS a FROM (SELECT DISTINCT yr FROM t) JOIN (SELECT DISTINCT bin FROM t) ON true LEFT JOIN t USING (yr, bin)),
    x AS (SELECT g.yr, greatest(g.n / g.a, 1e-4) AS p, greatest(q.n / q.a, 1e-4) AS q FROM g JOIN g AS q ON q.yr = 1995 AND q.bin = g.bin) SELECT yr, sum((p - q) * ln(p / q)) AS psi FROM x GROUP BY yr""",
    "psi",
)


def named(s: SparkSession, d: str) -> DataFrame:
    """Names of the features that an expansion over a column's values makes."""
    segs = features.segments_of(orders(s, d), "o_orderpriority")
    parts = features.expand(["o_totalprice"], ["sum"], [(1, 6)], segs)
    return s.createDataFrame([(str(p.segment[1]), p.name) for p in parts], "value string, name string")


register("P16_feature_names", named, "SELECT o_orderpriority AS value, 'SUM_O_TOTALPRICE_1_6_O_ORDERPRIORITY_' || trim(regexp_replace(upper(replace(o_orderpriority, '-', '_MINUS_')), '[^A-Z0-9]+', '_', 'g'), '_') AS name FROM (SELECT DISTINCT o_orderpriority FROM orders)")
register("O01_U02_sorted_power", lambda s, d: metrics.predictor_power(population(s, d).where("yr < 1996").unionByName(population(s, d).where("yr >= 1996")), COLUMNS, "y").orderBy(F.col("gini").desc(), "predictor").select("predictor", "gini"), " UNION ALL ".join(f"SELECT '{c}' AS predictor, gini FROM (WITH q AS (SELECT 1){gini_sql('-' + c)})" for c in COLUMNS).join((POP + "SELECT * FROM (", ")")), "gini")


def flagged(s: SparkSession, d: str) -> DataFrame:
    """The catalogue of a table's attributes through its file and back."""
    at = f"{folder(s)}/catalogue-{uuid.uuid4().hex}"
    made = tables.import_catalogue(table(s, d, "nation").select(F.concat(F.lit("data.nations[]."), F.lower(F.regexp_replace("n_name", " ", "_"))).alias("path")), "path", [("united", lambda c: c.contains("united"))])
    tables.save_catalogue(made, at)
    return tables.load_catalogue(s, at, made.schema).select("path", F.size("parts").alias("n_parts"), "depth", "family", "block")


register("S11_catalogue_file", flagged, "SELECT 'data.nations[].' || lower(replace(n_name, ' ', '_')) AS path, 3 AS n_parts, 1 AS depth, CASE WHEN contains(n_name, 'UNITED') THEN 'united' END AS family, CASE WHEN contains(n_name, 'UNITED') THEN 'united_1' ELSE 'other_1' END AS block FROM nation")
register(
    "T04_sessions",
    lambda s, d: streams.sessions(table(s, d, "events"), "user_id", "ts", "1 hour", "2 days").groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events")),
    "WITH a AS (SELECT user_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events) SELECT user_id, CAST(sum(fresh) AS BIGINT) AS n_sessions, count(*) AS n_events FROM a GROUP BY user_id",
)


def grouped(s: SparkSession, d: str) -> DataFrame:
    """Bins of all predictors, saved, loaded and applied."""
    rows = population(s, d)
    bins = binning.load(binning.save(binning.fit(rows, ["l_quantity", "l_discount"], ["seg"], "y", groups=3)))
    return binning.transform(rows, bins, "group_number").groupBy("l_quantity_GRP", "l_discount_GRP", "seg_GRP").count()


register("B21_grouping", grouped)


def written(s: SparkSession, d: str) -> DataFrame:
    """A table by partitions, its columns under shortened names; the catalogue forgets it, its files stay to be read."""
    name, at = f"written_{uuid.uuid4().hex}", f"{folder(s)}/written-{uuid.uuid4().hex}"
    rows = table(s, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("THE_BALANCE_OF_THE_CUSTOMERS_ACCOUNT"), F.col("c_nationkey").alias("the_balance_of_the_customers_accountants"))
    tables.write_table(rows, name, ["c_mktsegment"], path=at)
    out = s.table(name)
    s.sql(f"DROP TABLE {name}")
    return s.read.schema(out.schema).parquet(at)


register("S03_written_table", written, "SELECT c_custkey, c_mktsegment, c_acctbal AS the_balance_of_the_customers_a, c_nationkey AS the_balance_of_the_customers_1 FROM customer", "the_balance_of_the_customers_a")
