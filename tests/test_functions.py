"""Hand-computed cases."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from riskloom.functions import aggregates, expressions, times
from riskloom.operators import binning, categorical, cumulative, imputation, metrics, models, runs
from riskloom.plans import features, predicates


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(("start", "end", "months"), [("2020-01-31", "2020-02-29", 1), ("2020-01-15 12:00:00", "2020-02-15 00:00:00", 0), ("2020-01-01", "2021-01-01", 12), ("2019-03-31", "2019-03-31", 0)])
def test_whole_months(spark, start, end, months):
    assert one(spark, times.whole_units(ts(start), ts(end), "months")) == months
    assert one(spark, times.order_units(ts(start), ts(end), "months")) == months + 1


def test_units(spark):
    a, b = ts("2020-01-01 06:00:00"), ts("2020-01-15 05:59:59")
    assert one(spark, times.whole_units(a, b, "days")) == 13 and one(spark, times.whole_units(a, b, "w")) == 1
    assert one(spark, times.difference(a, b, "hours", "floor")) == 335
    assert one(spark, times.months_by_day(ts("2020-01-10"), ts("2020-03-10"))) == 2
    assert one(spark, times.fix_y2k(ts("2068-01-01"), ts("2020-01-01"))) == datetime.datetime(1968, 1, 1)
    assert one(spark, times.slice_bound(ts("2020-03-31"), 1, "months")) == datetime.datetime(2020, 2, 29)
    with pytest.raises(ValueError):
        times.unit("m")


def test_expressions(spark):
    n = lambda x: F.lit(x).cast("double")
    assert one(spark, expressions.ratio(n(1), n(0))) is None
    assert one(spark, expressions.fill_ratio(n(-2), n(0), inf=9)) == -9
    assert one(spark, expressions.treat(F.lit(float("-inf")), inf=5)) == -5 and one(spark, expressions.treat(F.lit(float("nan")), nan=1)) == 1
    assert [one(spark, expressions.bin_index(n(x), [1, 2])) for x in (0, 1, 1.5, 2)] == [0, 1, 1, 2]
    assert [one(spark, expressions.bin_index(n(x), [1, 2], "right")) for x in (0, 1, 1.5, 2)] == [0, 0, 1, 1]
    assert one(spark, expressions.expit(expressions.logit(n(0.3)))) == pytest.approx(0.3)
    assert one(spark, expressions.woe(n(1), n(3), n(3), n(6), 0.0)) == pytest.approx(math.log(2))
    assert one(spark, expressions.woe(n(2), n(3), n(3), n(6), 0.0)) == pytest.approx(-math.log(2))
    assert one(spark, expressions.woe(n(0), n(0), n(2), n(4), 0.0)) == 0


def test_aggregates(spark):
    df = spark.createDataFrame([(x, i) for i, x in enumerate([10.0, 3.0, 2.0, 4.0, 1.0])], "x double, t int")
    got = df.agg(*[aggregates.aggregate(f, F.col("x"), F.col("t")).alias(f) for f in ("skew", "median", "mad", "first", "last", "std", "nunique")]).first()
    assert got["skew"] == pytest.approx(1.697056, abs=1e-6) and (got["median"], got["first"], got["last"], got["nunique"]) == (3, 10, 1, 5)
    assert got["mad"] == pytest.approx(2.4)
    assert spark.createDataFrame([(x,) for x in "baab"], "x string").agg(aggregates.aggregate("mode", F.col("x")).alias("m")).first()["m"] == "a"
    with pytest.raises(ValueError):
        aggregates.aggregate("evil", F.col("x"))


def test_gini_ks_psi(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8), (None, 0.5), (1, None)], "y int, p double")
    got = metrics.discrimination(df, "p", "y").first()
    assert (got["auc"], got["gini"], got["ks"]) == pytest.approx((0.75, 0.5, 0.5))
    assert metrics.discrimination(df.where("y = 1"), "p", "y").first()["gini"] is None
    a, b = spark.createDataFrame([("u",), ("v",)], "c string"), spark.createDataFrame([("u",), ("v",), ("v",), ("v",)], "c string")
    assert metrics.psi_categories(a, b, "c").first()["psi"] == pytest.approx(0.274653, abs=1e-6)


def test_weighted_gini_equals_repeated_rows(spark):
    df = spark.createDataFrame([(i % 3 == 0, float((i * 7) % 10), 1 + i % 4) for i in range(60)], "b boolean, p double, w int").withColumn("y", F.col("b").cast("int"))
    repeated = df.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("w"))))
    assert metrics.discrimination(df, "p", "y", "w").first()["gini"] == pytest.approx(metrics.discrimination(repeated, "p", "y").first()["gini"])


def test_tree_edges_and_woe(spark):
    df = spark.createDataFrame([(float(x), y) for x, ys in ((0, "0000"), (1, "1100"), (2, "1111")) for y in map(int, ys)], "x double, y int")
    assert binning.fit_numeric(df, "x", "y", 3, 1).edges == [0.5, 1.5]
    two = spark.createDataFrame([(0.0, 0), (0.0, 0), (1.0, 1), (1.0, 1)], "x double, y int")
    b = binning.fit_numeric(two, "x", "y", 2, 1)
    assert b.edges == [0.5] and b.woes == pytest.approx([6.90875478, -6.90875478]) and b.nan_woe == 0
    nulls = spark.createDataFrame([(0.0, 0), (0.0, 0), (None, 0), (None, 1), (1.0, 1)], "x double, y int")
    b = binning.fit_numeric(nulls, "x", "y", 2, 1)
    assert [*b.woes, b.nan_woe] == pytest.approx([6.504121, -7.313388, -0.404634], abs=1e-5)
    assert binning.load(binning.save([b]))[0] == b
    spark.createDataFrame([(0.0,), (None,), (5.0,)], "x double").createOrReplaceTempView("t")
    assert [r["x_WOE"] for r in spark.sql(f"SELECT {b.sql()} FROM t").collect()] == pytest.approx([r["w"] for r in spark.table("t").select(b.woe().alias("w")).collect()])


def test_rare_categories_are_pooled(spark):
    df = spark.createDataFrame([(c, y) for c, ys in (("a", "11000"), ("b", "100"), ("c", "1"), ("d", "0")) for y in map(int, ys)], "c string, y int")
    b = binning.fit_categorical(df, "c", "y", 3, 3)
    assert any({"c", "d"} <= set(g) for g in b.groups)


def test_runs_by_hand(spark):
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate([5, 0, 3, 4])], "id int, t int, v int")
    r = runs.run_features(df, "id", "t", F.col("v") > 0).first()
    want = dict(sumis=3, sumnot=1, maxis=2, maxnot=1, meanis=1.5, meannot=1, maxconisfix=2, maxconnotfix=0, conis1=1, connot1=0, distconis1=0, distconnot1=0, r_sumis=0.75)
    assert {k: r[k] for k in want} == want


def test_isotonic():
    assert imputation.isotonic([(1, 1), (3, 1), (2, 1), (4, 2)]) == [1, 2.5, 2.5, 4]


def test_predicates_fail_closed(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert df.where(predicates.condition("a > 1 & b == 'x'")).count() == 1 and df.where(predicates.condition("b.isna()")).count() == 1
    with pytest.raises(Exception, match="."):
        df.where(predicates.condition("a >")).count()


def test_features_are_one_aggregation(spark):
    df = spark.createDataFrame([(1, datetime.datetime(2020, 1, 1), 5.0)], "id int, t timestamp_ntz, v double")
    e = features.Entity("id", "t", datetime.datetime(2020, 2, 1), "days")
    plan = features.Plan(e, features.expand(["v"], ["sum", "max", "mean"], [(1, 7), (1, 90), (1, None)]))
    out = features.build(df, plan)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate") == 1 and out.first()["SUM_V_1_90"] == 5 and out.first()["SUM_V_1_7"] is None
    with pytest.raises(ValueError):
        features.build(df, features.Plan(e, [features.Simple("nope", "sum")]))
    assert features.prune(out, "id", 0.5).columns == [c for c in out.columns if not c.endswith("_7")]


def test_tree_over_many_values_is_the_driver_tree(spark, monkeypatch):
    rows = spark.range(600).select((F.col("id") % 97).alias("x"), (F.pmod(F.xxhash64("id"), F.lit(100)) < F.col("id") % 97).cast("int").alias("y"))
    table = binning.value_table(rows, "x", "y")
    want = {n: binning.tree_edges(table, n, 5) for n in (2, 4, 7)}
    monkeypatch.setattr(binning, "VALUES", 10)
    assert {n: binning.tree_edges(table, n, 5) for n in want} == want and len(want[7]) == 6 and want[7][:3] == want[4]


def test_percentiles_are_exact(spark):
    rows = spark.createDataFrame([(None if i % 7 == 0 else i % 2, float(i * i % 53) if i % 5 else None) for i in range(200)], "g int, x double")
    got = {r["g"]: r["q"] for r in cumulative.percentiles(rows, "x", (0.0, 0.1, 0.5, 0.99, 1.0), ("g",)).collect()}
    want = {r["g"]: r["q"] for r in rows.groupBy("g").agg(F.percentile("x", F.array(*[F.lit(p) for p in (0.0, 0.1, 0.5, 0.99, 1.0)])).alias("q")).collect()}
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g]) for g in want)
    assert cumulative.percentiles(rows.limit(0), "x", (0.5,)).first()["q"] == [None]


def test_more_features_than_generated_code_holds_keep_a_null_entity(spark):
    rows = spark.createDataFrame([(1, datetime.datetime(2020, 1, 5), 2.0), (None, datetime.datetime(2020, 1, 6), 3.0)], "id long, t timestamp_ntz, x double")
    plan = features.Plan(features.Entity("id", "t", datetime.datetime(2020, 1, 10), "days"))
    plan.simple = features.expand(["x"], ["sum"], [(1, k) for k in range(1, 402)])
    out = features.build(rows, plan)
    assert len(out.columns) == 402 and {r["id"] for r in out.collect()} == {1, None}


def test_rank_stability_by_hand(spark):
    """Months 1 to 3 rank the bins a b, a b, b a: shares 2/3 and 2/3; in either rank the shares are 2/3 and 1/3."""
    bad = {(1, "a"): 1, (1, "b"): 0, (2, "a"): 1, (2, "b"): 0, (3, "a"): 0, (3, "b"): 1}
    rows = spark.createDataFrame([(m, b, y) for (m, b), y in bad.items()], "m int, b string, y int")
    r = metrics.rank_stability(rows, "b", "m", "y").first()
    assert r["rsi"] == pytest.approx(2 / 3) and r["rsi_product"] == pytest.approx(2 / 9)


def test_niv_by_hand(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("a", 0, 0), ("b", 1, 0), ("b", 0, 1), ("b", 0, 0)], "b string, t int, y int")
    # counts and one of (treated, target): a: 2 2 1 2, b: 1 2 2 2, so shares a: 2/3 1/2 1/3 1/2 and b: 1/3 1/2 2/3 1/2
    want = (2 / 3 * 1 / 2 - 1 / 2 * 1 / 3) * math.log((2 / 3 * 1 / 2) / (1 / 2 * 1 / 3)) + (1 / 3 * 1 / 2 - 1 / 2 * 2 / 3) * math.log((1 / 3 * 1 / 2) / (1 / 2 * 2 / 3))
    assert metrics.niv(rows, "b", "y", "t").first()["niv"] == pytest.approx(want)


def test_all_modes(spark):
    rows = spark.createDataFrame([(1, c) for c in "edcba"] + [(2, "x"), (2, "x"), (2, "y")], "k int, c string")
    got = {r["k"]: list(r[1:]) for r in categorical.modes(rows, "k", "c").collect()}
    assert got == {1: list("abcde"), 2: ["x", None, None, None, None]}


@pytest.mark.parametrize(("x", "df", "p"), [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05), (9.487729036781154, 4, 0.05), (11.070497693516351, 5, 0.05), (0.0, 3, 1.0)])
def test_chi_square_tail(x, df, p):
    assert models.chi_square_tail(x, df) == pytest.approx(p, abs=1e-9)


def test_k_means_of_variables(spark):
    rows = spark.range(200).select(F.rand(1).alias("a"), F.rand(2).alias("b")).select("a", (F.col("a") * 2 + F.rand(3) / 50).alias("a2"), "b", (1 - F.col("b")).alias("nb"), (F.col("b") * 3).alias("b3"))
    got = models.k_means_variables(rows, ["a", "a2", "b", "b3", "nb"], 3)
    assert got["a"] == got["a2"] and got["b"] == got["b3"] and len({got["a"], got["b"], got["nb"]}) == 3


def test_likelihood_ratio_sees_what_matters(spark):
    rows = spark.range(2000).select(F.rand(1).alias("x"), F.rand(2).alias("z"), F.rand(3).alias("u")).select("x", "z", (F.col("u") < F.col("x")).cast("int").alias("y"))
    assert models.likelihood_ratio_test(rows, ["z"], ["z", "x"], "y")[1] < 1e-6 < models.likelihood_ratio_test(rows, ["x"], ["x", "z"], "y")[1]


def test_plans_by_condition_give_what_one_aggregation_gives(spark, monkeypatch):
    rows = spark.range(400).select((F.col("id") % 7).alias("id_"), F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(cast(id % 97 as int))").alias("t"), F.when(F.col("id") % 5 > 0, (F.col("id") * 37 % 101).cast("double")).alias("x"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 2)).alias("seg"))
    rows = rows.withColumn("id_", F.when(F.col("id_") > 0, F.col("id_")))
    plan = features.Plan(features.Entity("id_", "t", datetime.datetime(2020, 4, 1), "days"), count="N")
    plan.simple = features.expand(["x"], ["sum", "mean", "count", "nunique", "last", "max"], [(1, 10), (5, None)], [None, ("seg", "s0"), ("seg", None), ("seg", "none")], [None, "x > 50"])
    plan.ratios = [features.Ratio(features.Simple("x", "sum", 1, 3), plan.simple[0], -1.0, 9.0)]
    plan.since = [features.TimeSince("last"), features.TimeSince("first", "days", "x > 90")]
    wanted = features.build(rows, plan).toPandas().sort_values("id_").reset_index(drop=True)
    monkeypatch.setattr(features, "WIDE", 1)
    import pandas as pd

    pd.testing.assert_frame_equal(features.build(rows, plan).toPandas().sort_values("id_").reset_index(drop=True), wanted)
