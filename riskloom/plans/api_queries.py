"""Queries over the smaller parts of the API: text twins of plans and bins, predicates, pruning, pieces of reports, model checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import aggregates, expressions, times
from riskloom.operators import binning, cumulative, interactions, metrics, models, profile, reports, score_models
from riskloom.plans import features, predicates
from riskloom.plans.catalogue import register, table
from riskloom.plans.feature_queries import AGE, ENTITY, SQL_END, orders
from riskloom.plans.measure_queries import POP, gini_sql, population
from riskloom.sources import tables
from riskloom.sources.shared import folder

COLUMNS = ["l_quantity", "l_discount", "l_extendedprice"]


def _config(s: SparkSession, d: str) -> tuple[features.Plan, DataFrame]:
    events = orders(s, d)
    meta = {"id": ENTITY.id, "time": ENTITY.time, "reference": ENTITY.reference, "unit": ENTITY.unit}
    part = {"columns": ["o_totalprice"], "funcs": ["sum", "max"], "ranges": [(1, 6), (1, None)], "queries": ["o_orderstatus == 'F'"]}
    return features.from_config({"meta": meta, "simple": [part]}, events), events


def sql_twin(s: SparkSession, d: str) -> DataFrame:
    """A configured plan as SQL text, run over a view with the ages."""
    plan, events = _config(s, d)
    view = f"aged_{uuid.uuid4().hex}"
    events.where(F.col("o_orderdate") <= plan.entity.end()).withColumn("_age", plan.entity.age()).createOrReplaceTempView(view)
    out = s.sql(features.sql_text(plan, view))
    return out.toDF("o_custkey", *[f"f{i}" for i in range(len(out.columns) - 1)])


_F = "CASE WHEN o_orderstatus = 'F'"
register(
    "A03_A04_X07_X08_sql_twin",
    sql_twin,
    f"SELECT o_custkey, sum({_F} AND age <= 6 THEN o_totalprice END) AS f0, sum({_F} THEN o_totalprice END) AS f1, max({_F} AND age <= 6 THEN o_totalprice END) AS f2, max({_F} THEN o_totalprice END) AS f3 FROM (SELECT *, {AGE} AS age FROM orders WHERE o_orderdate <= {SQL_END}) GROUP BY o_custkey",
    "f0 f1 f2 f3",
)


def built(s: SparkSession, d: str) -> DataFrame:
    plan, events = _config(s, d)
    plan.count = "ORIG_ROWS_COUNT"
    out = features.build(events, plan, table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey")))
    return out.select("o_custkey", F.col(plan.simple[0].name).alias("f0"), "ORIG_ROWS_COUNT")


register("A05_J03_rows_count", built, f"SELECT c_custkey AS o_custkey, f0, n AS ORIG_ROWS_COUNT FROM customer LEFT JOIN (SELECT o_custkey, sum({_F} AND age <= 6 THEN o_totalprice END) AS f0, count(*) AS n FROM (SELECT *, {AGE} AS age FROM orders WHERE o_orderdate <= {SQL_END}) GROUP BY o_custkey) ON c_custkey = o_custkey", "f0")


def invalid(s: SparkSession, d: str) -> DataFrame:
    """Names of parts that do not fit the table."""
    plan, events = _config(s, d)
    plan.simple += [features.Simple("no_such", "sum", 1, 2), features.Simple("o_totalprice", "max", 5, 2)]
    bad = features.validate(plan, events)
    return s.range(1).select(F.explode(F.array(*[F.lit(int(p.name in bad)) for p in plan.simple])).alias("bad")).groupBy("bad").count()


register("P09_validate", invalid, "SELECT 1 AS bad, CAST(2 AS BIGINT) AS count UNION ALL SELECT 0, 4")
register("P02_predicate_text", lambda s, d: orders(s, d).where(predicates.condition('o_orderstatus == "F" & o_totalprice.notna() & (o_totalprice > 100000 | o_orderpriority == "5-LOW")')).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice IS NOT NULL AND (o_totalprice > 100000 OR o_orderpriority = '5-LOW')")
register("P05_age_range", lambda s, d: orders(s, d).where(ENTITY.age().between(2, 5)).groupBy("o_custkey").agg(F.count("*").alias("n")), f"SELECT o_custkey, count(*) AS n FROM (SELECT *, {AGE} AS age FROM orders) WHERE age BETWEEN 2 AND 5 GROUP BY o_custkey")
register("P11_P12_prune", lambda s, d: features.prune(orders(s, d).groupBy("o_custkey").agg(F.max("o_totalprice").alias("filled"), F.max(F.when(F.col("o_custkey") % 10 == 0, F.col("o_totalprice"))).alias("scarce")), "o_custkey", 0.5), "SELECT o_custkey, max(o_totalprice) AS filled FROM orders GROUP BY o_custkey", "filled")


def wide(s: SparkSession, d: str) -> DataFrame:
    return orders(s, d).select("o_orderkey", "o_orderstatus", "o_totalprice", F.when(F.col("o_orderkey") % 50 == 0, F.lit(1.0)).alias("scarce"), F.lit(1).alias("constant"))


_P13 = ("o_orderkey", "o_orderstatus", "o_totalprice", "scarce", "constant")
_P13_SQL = {"scarce": "CASE WHEN o_orderkey % 50 = 0 THEN 1.0 END", "constant": "1"}
register(
    "P13_column_profile",
    lambda s, d: profile.column_profile(wide(s, d), _P13),
    "SELECT *, fill >= 0.05 AND n_distinct >= 2 AND (kind = 'numerical' OR n_distinct <= 20) AS kept FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{'categorical' if c == 'o_orderstatus' else 'numerical'}' AS kind, count({_P13_SQL.get(c, c)}) / count(*) AS fill, count(DISTINCT {_P13_SQL.get(c, c)}) AS n_distinct FROM orders" for c in _P13) + ")",
    "fill",
)
register("P13_drop_columns", lambda s, d: profile.drop_columns(wide(s, d), _P13), "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders", "o_totalprice")

BINS = binning.Bins("l_quantity", edges=[10.0, 25.0, 40.0], woes=[0.5, 0.25, -0.25, -0.5])


def bins_as_text(s: SparkSession, d: str) -> DataFrame:
    """Bins through their saved form, as short names and as SQL text."""
    bins = binning.load(binning.save([BINS]))[0]
    rows = population(s, d)
    named = rows.select(bins.short_name().alias("name"), F.expr(bins.sql().rsplit(" AS ", 1)[0]).alias("woe"))
    return named.groupBy("name", "woe").agg(F.count("*").alias("n"))


register("B11_B16_B17_S15_bins_as_text", bins_as_text, POP + "SELECT CASE WHEN l_quantity < 10 THEN '[-inf, 10.000)' WHEN l_quantity < 25 THEN '[10.000, 25.000)' WHEN l_quantity < 40 THEN '[25.000, 40.000)' ELSE '[40.000, inf)' END AS name, CASE WHEN l_quantity < 10 THEN 0.5 WHEN l_quantity < 25 THEN 0.25 WHEN l_quantity < 40 THEN -0.25 ELSE -0.5 END AS woe, count(*) AS n FROM p GROUP BY ALL", "woe")
register("B24_histogram_with_bads", lambda s, d: metrics.histogram(population(s, d), "l_quantity", 10, "y").select("bin", "n", "bads"), POP + ", r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM p) SELECT CAST(least(9, floor((l_quantity - lo) / (hi - lo) * 10)) AS INTEGER) AS bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS bads FROM p, r GROUP BY 1")
register("R08_lift_by_segment", lambda s, d: metrics.lift(population(s, d), "l_extendedprice", "y", 10, "high", ("seg",)), POP + "SELECT seg, avg(CASE WHEN l_extendedprice >= c THEN CAST(y AS DOUBLE) END) / avg(y) AS lift FROM p JOIN (SELECT seg, quantile_cont(l_extendedprice, 0.9) AS c FROM p GROUP BY seg) USING (seg) GROUP BY seg", "lift")
register("R11_grouping_evaluation", lambda s, d: binning.bin_table(population(s, d), BINS.index(), "y").select("bin", "n", "bads", "rate", "share"), POP + "SELECT CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 25 THEN 1 WHEN l_quantity < 40 THEN 2 ELSE 3 END AS bin, count(*) AS n, sum(y) AS bads, avg(y) AS rate, count(*) / sum(count(*)) OVER () AS share FROM p GROUP BY 1", "n bads rate share")
register("R12_continuous_evaluation", lambda s, d: reports.log_risk(population(s, d), "l_extendedprice", "y", 4, "yr"), POP + ", e AS (SELECT " + ", ".join(f"quantile_cont(l_extendedprice, {i / 4}) AS e{i}" for i in range(1, 4)) + " FROM p), b AS (SELECT yr, " + " + ".join(f"CAST(l_extendedprice > e{i} AS INTEGER)" for i in range(1, 4)) + " AS bin, y FROM p, e) SELECT yr AS month, bin, count(*) AS n, avg(y) AS rate, CASE WHEN avg(y) > 0 AND avg(y) < 1 THEN ln(avg(y) / (1 - avg(y))) END AS log_risk FROM b GROUP BY yr, bin", "rate log_risk")
register("M36_gini_of_two", lambda s, d: metrics.discrimination(population(s, d), "l_quantity", "y").select(F.lit("l_quantity").alias("score"), "gini").unionByName(metrics.discrimination(population(s, d), "l_discount", "y").select(F.lit("l_discount").alias("score"), "gini")), POP + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS score, 2 * auc - 1 AS gini FROM (SELECT sum(bad * (cg - good / 2)) / max(ab * ag) AS auc FROM (SELECT *, sum(good) OVER (ORDER BY score) AS cg, sum(bad) OVER () AS ab, sum(good) OVER () AS ag FROM (SELECT {c} AS score, CAST(sum(y) AS DOUBLE) AS bad, CAST(sum(1 - y) AS DOUBLE) AS good FROM p GROUP BY 1)))" for c in ("l_quantity", "l_discount")) + ")", "gini")
register("W09_running_sums", lambda s, d: cumulative.running(metrics.score_table(population(s, d), "l_quantity", "y"), (), "score", ("bad", "good")).select("score", "cum_bad", "cum_good", "all_bad", "all_good"), POP + "SELECT score, sum(bad) OVER w AS cum_bad, sum(good) OVER w AS cum_good, sum(bad) OVER () AS all_bad, sum(good) OVER () AS all_good FROM (SELECT l_quantity AS score, CAST(sum(y) AS DOUBLE) AS bad, CAST(sum(1 - y) AS DOUBLE) AS good FROM p GROUP BY 1) WINDOW w AS (ORDER BY score)", "score cum_bad cum_good all_bad all_good")
register("O09_rank_groups", lambda s, d: profile.rank_groups(population(s, d), "yr", "y"), POP + "SELECT yr AS value, avg(y) AS rate, CAST(row_number() OVER (ORDER BY avg(y), yr) AS INTEGER) AS rank FROM p GROUP BY yr", "rate")
register("F26_percent_table", lambda s, d: profile.percent_table(population(s, d), "yr", "y"), POP + "SELECT yr AS value, count(*) AS n, round_even(100 * count(*) / sum(count(*)) OVER (), 2) AS share_pct, round_even(100 * avg(y), 2) AS rate_pct FROM p GROUP BY yr", "share_pct rate_pct")
register("F18_I08_treatment", lambda s, d: population(s, d).select("l_orderkey", "l_linenumber", expressions.treat(F.when(F.col("l_quantity") < 5, F.lit(float("nan"))).when(F.col("l_quantity") < 10, F.lit(float("inf"))).otherwise(F.col("l_quantity")), -1.0, 999.0).alias("x")), POP + "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 THEN -1 WHEN l_quantity < 10 THEN 999 ELSE l_quantity END AS x FROM p", "x")
register("F07_F08_units", lambda s, d: orders(s, d).select("o_orderkey", *[times.order_units(F.col("o_orderdate"), ENTITY.end(), u).alias(f"in_{u}") for u in ("w", "day", "hr")]), f"SELECT o_orderkey, date_diff('second', CAST(o_orderdate AS TIMESTAMP), {SQL_END}) // 604800 + 1 AS in_w, date_diff('second', CAST(o_orderdate AS TIMESTAMP), {SQL_END}) // 86400 + 1 AS in_day, date_diff('second', CAST(o_orderdate AS TIMESTAMP), {SQL_END}) // 3600 + 1 AS in_hr FROM orders")
register("F25_cost_benefit", lambda s, d: population(s, d).select("l_orderkey", "l_linenumber", expressions.cost_benefit(F.col("l_extendedprice"), F.col("l_quantity"), 1.5, 0.9).alias("gain")), POP + "SELECT l_orderkey, l_linenumber, l_quantity * 0.5 * 0.9 - l_extendedprice * (1 - 0.9::DOUBLE) AS gain FROM p", "gain")


def cached(s: SparkSession, d: str) -> DataFrame:
    """A statement's result, kept in the shared folder."""
    return tables.read_sql(s, f"SELECT n_regionkey, count(*) AS n FROM parquet.`{d}/nation.parquet` GROUP BY n_regionkey", f"{folder(s)}/statements-{uuid.uuid4().hex}")


register("S02_cached_statement", cached, "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")


def parts(s: SparkSession, d: str) -> DataFrame:
    """Part files as CSV, read as one table."""
    at = f"{folder(s)}/parts-{uuid.uuid4().hex}"
    nation = table(s, d, "nation").select("n_nationkey", "n_name")
    for k in (0, 1):
        nation.where(F.col("n_nationkey") % 2 == k).write.option("header", True).csv(f"{at}/{k}")
    return tables.read_parts(s, [f"{at}/0", f"{at}/1"], "n_nationkey bigint, n_name string")


register("S01_S16_csv_parts", parts, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")


def halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = population(s, d).withColumn("k", models.fold("l_orderkey", 2))
    return rows.where("k = 0"), rows.where("k = 1")


def _listed(s: SparkSession, rows: list, schema: str) -> DataFrame:
    return s.createDataFrame(rows, schema)


CLUSTERS = {"l_quantity": 0, "l_extendedprice": 0, "l_discount": 1}
register("L02_cross_validated_gini", lambda s, d: _listed(s, [(models.cross_validated_gini(population(s, d), COLUMNS[:2], "y", "l_orderkey", 2),)], "gini double"))
register("L03_lasso_path", lambda s, d: _listed(s, models.lasso_path(*halves(s, d), COLUMNS, "y", [0.0, 0.05]), "penalty double, n_columns int, gini double"))
register("L06_R18_marginal_contributions", lambda s, d: _listed(s, models.marginal_contributions(*halves(s, d), COLUMNS[:2], "y"), "column string, gini double"))
register("R19_marginal_additions", lambda s, d: _listed(s, models.marginal_additions(*halves(s, d), COLUMNS[:1], COLUMNS[1:], "y"), "column string, gini double"))
register("R20_marginal_lifts", lambda s, d: _listed(s, models.marginal_lifts(*halves(s, d), COLUMNS[:2], "y"), "column string, lift double"))
register("L04_surrogates", lambda s, d: _listed(s, models.surrogates(*halves(s, d), ["l_quantity", "l_discount"], CLUSTERS, "y"), "column string, surrogate string, gini double"))
register("L08_cluster_means", lambda s, d: models.cluster_means(population(s, d), CLUSTERS).select("l_orderkey", "l_linenumber", "cluster_0", "cluster_1"), POP + "SELECT l_orderkey, l_linenumber, (l_quantity + l_extendedprice) / 2 AS cluster_0, l_discount AS cluster_1 FROM p", "cluster_0 cluster_1")
register("L09_k_means_variables", lambda s, d: _listed(s, sorted(models.k_means_variables(population(s, d), COLUMNS, 2).items()), "column string, cluster int"))
register("L22_likelihood_ratio", lambda s, d: _listed(s, [models.likelihood_ratio_test(population(s, d), COLUMNS[:1], COLUMNS, "y")], "statistic double, p_value double"))
register("O02_best_model", lambda s, d: _listed(s, [models.best_model(halves(s, d)[1], [models.fit_logit(halves(s, d)[0], c, "y") for c in (COLUMNS[:1], COLUMNS[:2], COLUMNS)], "y", 2)], "model int, gini double"))


def boosted(s: SparkSession, d: str) -> DataFrame:
    """A boosted model's raw score from its SQL text."""
    model = models.fit_boosted(population(s, d), COLUMNS, "y", 2, 2)
    return population(s, d).select("l_orderkey", "l_linenumber", F.expr(models.tree_sql(model, COLUMNS)).alias("raw"))


register("L10_L13_boosted_as_sql", boosted)


def general(s: SparkSession, d: str) -> DataFrame:
    """A cross-validated model over two scores, one a probability with gaps."""
    rows = population(s, d).withColumn("pd", F.when(F.col("l_quantity") > 10, F.col("l_discount") + 0.01))
    fill = score_models.Imputation("pd", "pd IS NOT NULL", "pd IS NULL")
    model, gini = score_models.fit_general(rows, ["pd", "l_quantity"], "y", "l_orderkey", [fill], ["pd"], 2)
    return rows.select(F.lit(gini).alias("gini"), model.score().alias("score")).groupBy("gini").agg(F.avg("score").alias("mean_score"), F.count("score").alias("n"))


register("L16_L17_X04_general_model", general)


def searched(s: SparkSession, d: str) -> DataFrame:
    found, c, _ = score_models.search(population(s, d), COLUMNS[:2], "y", "l_orderkey", (0.01, 1.0), 2)
    return _listed(s, [(c, g, x) for g, x in found], "c double, gini double, lift double")


register("L14_L15_model_search", searched)


def calibrated(s: SparkSession, d: str) -> DataFrame:
    rows = population(s, d).withColumn("base", F.lit(1)).withColumn("part", F.when(F.col("l_orderkey") % 3 > 0, "train").otherwise("test"))
    model = score_models.fit_calibrated(rows, COLUMNS[:2], "y", "base", 1.0, "part")
    return rows.groupBy("part").agg(F.avg(model.good_score()).alias("good_score"), F.avg("y").alias("rate"))


register("L23_calibrated_scores", calibrated)
_ICE = models.Logit(["l_quantity", "l_discount"], [0.02, -3.0], -0.5)
register(
    "R26_conditional_expectations",
    lambda s, d: score_models.conditional_expectations(population(s, d), _ICE, "l_quantity", ["l_orderkey", "l_linenumber"], 50, 5),
    POP + ", few AS (SELECT * FROM p ORDER BY md5(concat_ws('-', l_orderkey, l_linenumber)), l_orderkey, l_linenumber LIMIT 50), g AS (SELECT DISTINCT unnest(quantile_cont(CAST(l_quantity AS DOUBLE), [0, 0.25, 0.5, 0.75, 1])) AS point FROM few) SELECT l_orderkey, l_linenumber, point, 1 / (1 + exp(0.5::DOUBLE - 0.02::DOUBLE * point + 3 * l_discount)) AS score FROM few, g",
    "point score",
)
_CLUSTERED = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {k} AS cluster, (SELECT gini FROM (WITH z AS (SELECT 1){gini_sql('-' + c)})) AS gini" for c, k in CLUSTERS.items())
register("W12_cluster_order", lambda s, d: score_models.cluster_table(population(s, d), CLUSTERS, "y"), POP + f"SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY gini DESC, \"column\") AS INTEGER) AS \"order\" FROM ({_CLUSTERED})", "gini")
_RANKED = ", t AS (SELECT yr AS month, seg AS bin, avg(y) AS rate, dense_rank() OVER (PARTITION BY yr ORDER BY avg(y) DESC) AS rank FROM p GROUP BY yr, seg)"
register(
    "J15_steady_ranks",
    lambda s, d: interactions.steady_ranks(population(s, d), "seg", "yr", "y", 0.3).withColumn("rank", F.col("rank").cast("int")),
    POP + _RANKED + ", l AS (SELECT bin, CASE WHEN rank <> lead(rank) OVER v THEN abs(rate - lead(rate) OVER v) ELSE 0 END AS leap FROM t WINDOW v AS (PARTITION BY bin ORDER BY month)), m AS (SELECT bin, max(leap) AS leap FROM l GROUP BY bin), c AS (SELECT bin, rank, row_number() OVER (PARTITION BY bin ORDER BY count(*) DESC, rank) AS k FROM t GROUP BY bin, rank) SELECT t.bin, month, rate, CAST(CASE WHEN leap <= 0.3 * (SELECT max(rate) - min(rate) FROM t) THEN c.rank ELSE t.rank END AS INTEGER) AS rank FROM t JOIN m ON t.bin = m.bin JOIN c ON t.bin = c.bin AND k = 1",
    "rate",
)
_EDGES = (25.0, 10.0, 40.0)
register(
    "W18_stability_by_bins",
    lambda s, d: interactions.stability_by_bins(population(s, d), "l_quantity", _EDGES, "yr", "y"),
    POP + ", b AS (" + " UNION ALL ".join(f"SELECT {k + 1} AS n_bins, yr, y, " + " + ".join(f"CAST(l_quantity >= {e} AS INTEGER)" for e in _EDGES[:k]) + " AS bin FROM p" for k in (1, 2, 3)) + "), t AS (SELECT n_bins, bin, dense_rank() OVER (PARTITION BY n_bins, yr ORDER BY avg(y) DESC) AS rank FROM b GROUP BY n_bins, yr, bin), c AS (SELECT n_bins, bin, rank, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT n_bins, avg(share) AS rsi FROM (SELECT n_bins, bin, max(n) / sum(n) AS share FROM c GROUP BY n_bins, bin) GROUP BY n_bins) SELECT n_bins, CASE WHEN rsi = 1 AND lag(rsi) OVER w < 1 THEN lag(rsi) OVER w ELSE rsi END AS rsi FROM r WINDOW w AS (ORDER BY n_bins)",
    "rsi",
)
register("W16_pages", lambda s, d: cumulative.pages(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 1000), "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS INTEGER) AS page FROM orders")
register("A43_cost_of_features", lambda s, d: features.cost(*_config(s, d)), "SELECT 'o_totalprice' AS \"column\", 4 AS n_features, 8.0 * 4 * count(DISTINCT o_custkey) AS bytes FROM orders", "bytes")
_DESCRIBED = ("o_totalprice", "o_orderstatus", "o_orderdate")
register(
    "X10_column_descriptors",
    lambda s, d: profile.descriptors(table(s, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date")), _DESCRIBED),
    "WITH o AS (SELECT CAST(o_totalprice AS DOUBLE) AS v, o_orderstatus AS c, CAST(o_orderdate AS DATE) AS t FROM orders) SELECT 'o_totalprice' AS \"column\", 'numeric' AS kind, count(DISTINCT v) AS n_unique, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS minimum, max(v) AS maximum, NULL::VARCHAR AS mode, NULL::VARCHAR AS first_time, NULL::VARCHAR AS last_time FROM o UNION ALL SELECT 'o_orderstatus', 'categorical', count(DISTINCT c), NULL, NULL, NULL, NULL, (SELECT c FROM o WHERE c IS NOT NULL GROUP BY c ORDER BY count(*) DESC, c LIMIT 1), NULL, NULL FROM o UNION ALL SELECT 'o_orderdate', 'time', count(DISTINCT t), NULL, NULL, NULL, NULL, NULL, CAST(min(t) AS VARCHAR), CAST(max(t) AS VARCHAR) FROM o",
    "mean std minimum maximum",
)


def offered(s: SparkSession, d: str) -> DataFrame:
    """What is offered for each column of a table by its kind."""
    kinds = [(c, profile.kind_of(t)) for c, t in table(s, d, "nation").dtypes]
    return _listed(s, [(c, k, f) for c, k in kinds for f in sorted(aggregates.OFFERED[k])], "column string, kind string, function string")


register("X09_functions_by_kind", offered)
