"""Models over scores, profiles and ranks against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from riskloom.operators import cumulative, imputation, interactions, metrics, profile, reports, score_models
from riskloom.operators.models import Logit
from riskloom.operators.score_models import Imputation


@pytest.fixture(scope="module")
def scored(spark):
    rows = spark.range(3000).select("id", F.rand(1).alias("p"), F.rand(2).alias("x"), F.rand(3).alias("u"), F.rand(4).alias("gap"))
    rows = rows.select("id", F.when(F.col("gap") > 0.2, 0.05 + 0.9 * F.col("p")).alias("pd"), "x", (F.col("u") < F.col("p")).cast("int").alias("y"))
    return rows.cache()


def test_linear_imputation_is_the_proportion(scored):
    one = score_models.learn(scored, Imputation("pd", "pd IS NOT NULL", "pd IS NULL"), "y", ["pd"])
    rows = scored.collect()
    hit, nohit = [r for r in rows if r["pd"] is not None], [r for r in rows if r["pd"] is None]
    rate = lambda rs: sum(r["y"] for r in rs) / len(rs)
    p = sum(r["pd"] for r in hit) / len(hit) * rate(nohit) / rate(hit)
    assert one.value == pytest.approx(math.log(p / (1 - p)), abs=1e-9)
    assert score_models.learn(scored, Imputation("pd", "true", "false", 0.5), "y").value == 0.5
    assert score_models.learn(scored, Imputation("x", "x >= 0", "x < 0"), "y").value is None  # nothing to fill


@pytest.mark.parametrize("kind", ["linear", "quantile"])
def test_general_model(scored, kind):
    fill = Imputation("pd", "pd IS NOT NULL", "pd IS NULL")
    model, gini = score_models.fit_general(scored, ["pd", "x"], "y", "id", [fill], ["pd"], 3, kind=kind)
    b, c, a, v = *model.model.coefficients, model.model.intercept, model.imputations[0].value
    assert gini > 0.4 and b > 0.5 and abs(c) < 0.6
    for r in scored.select("*", model.score().alias("s")).limit(300).collect():
        x = v if r["pd"] is None else math.log(r["pd"] / (1 - r["pd"]))
        assert r["s"] == pytest.approx(1 / (1 + math.exp(-(a + b * x + c * r["x"]))), abs=1e-9)
    assert model.impute(scored).where("pd IS NULL").count() == 0


def test_quantile_imputer_follows_the_direction(scored):
    up = imputation.quantile_imputer(scored, "pd", "y", 20)
    down = imputation.quantile_imputer(scored.withColumn("pd", -F.col("pd")), "pd", "y", 20)
    assert up == pytest.approx(-down, abs=0.1) and 0.2 < up < 0.8


def test_search_and_codes(scored):
    coded = scored.withColumn("pd", F.when(F.col("id") % 10 == 0, -1.0).otherwise(F.col("pd")))
    found, c, model = score_models.search(coded, ["pd", "x"], "y", "id", (0.001, 1.0), 2, logits=["pd"], codes={"pd": [-1.0]})
    assert len(found) == 2 and c in (0.001, 1.0) and min(g for g, _ in found) > 0.3
    assert {i.nohit for i in model.imputations} == {"`pd` IS NULL", "`pd` = -1.0D"}
    assert coded.where(model.score().isNull()).count() == 0


def test_search_shares_what_no_penalty_changes(scored, monkeypatch):
    """Measures of each split as by separate passes; imputations are found once a split and once at the end."""
    calls, real = [], score_models.missing_kinds
    monkeypatch.setattr(score_models, "missing_kinds", lambda *a: calls.append(1) or real(*a))
    found, c, _ = score_models.search(scored, ["pd", "x"], "y", "id", (0.001, 1.0, 10.0), 2, logits=["pd"])
    assert len(calls) == 3
    for i, (gini, lift) in enumerate(found):
        out = F.pmod(F.xxhash64(F.col("id"), F.lit(i)), F.lit(10**6)) < 330_000
        model = score_models.fit_scores(scored.where(~out), ["pd", "x"], "y", c, ["pd"])
        held = scored.where(out).select("y", model.score().alias("s"))
        assert gini == pytest.approx(metrics.discrimination(held, "s", "y").first()["gini"])
        assert lift == pytest.approx(metrics.lift(held, "s", "y", 10, "high").first()["lift"])


def test_calibrated_scores_meet_the_rate(scored):
    rows = scored.withColumn("base", (F.col("id") % 5 > 0).cast("int"))
    model = score_models.fit_calibrated(rows, ["pd", "x"], "y", "base", 0.01, logits=["pd"])
    mean, rate = rows.where("base = 1").agg(F.avg(model.good_score()), F.avg("y")).first()
    assert mean == pytest.approx(1 - rate, abs=1e-3)


def test_conditional_expectations(scored):
    got = score_models.conditional_expectations(scored, Logit(["pd", "x"], [1.0, 2.0], 0.0), "x", ["id"], 30, 4)
    assert got.count() == 120 and got.select("id").distinct().count() == 30
    empty = score_models.conditional_expectations(scored.where("false"), Logit(["x"], [1.0], 0.0), "x", ["id"])
    assert empty.count() == 0


def test_conditional_expectations_of_tied_keys(spark):
    """The limit falls among rows of one key: the same of them in any order, and points are of those that are kept."""
    model = Logit(["x"], [1.0], 0.0)
    for order in ([5.0, 4.0, 3.0, 1.0, 2.0], [1.0, 2.0, 3.0, 4.0, 5.0], [3.0, 5.0, 1.0, 2.0, 4.0]):
        rows = spark.createDataFrame([(7, x) for x in order], "id int, x double").repartition(3)
        got = score_models.conditional_expectations(rows, model, "x", ["id"], 2, 3).collect()
        assert sorted(r["point"] for r in got) == [1.0, 1.0, 1.5, 1.5, 2.0, 2.0]


def test_descriptors_of_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(1, "b", None), (1, "a", None), (None, "a", None), (3, "b", None)], "n int, c string, t date")
    got = {r["column"]: r for r in profile.descriptors(rows, ["n", "c", "t"]).collect()}
    assert got["n"]["n_unique"] == 2 and got["n"]["std"] == pytest.approx(math.sqrt(4 / 3)) and got["n"]["mode"] is None
    assert got["c"]["mode"] == "a" and got["t"]["n_unique"] == 0 and got["t"]["first_time"] is None
    assert profile.descriptors(rows.where("false"), ["n", "c"]).count() == 0


def test_pages(spark):
    got = cumulative.pages(spark.range(0, 700, 7), "id", 30)
    assert {r["page"]: r["n"] for r in got.groupBy("page").agg(F.count("*").alias("n")).collect()} == {0: 30, 1: 30, 2: 30, 3: 10}


def test_steady_ranks_keep_the_commonest(spark):
    rates = {"a": [0.5, 0.5, 0.28, 0.5], "b": [0.3, 0.3, 0.3, 0.3], "c": [0.1, 0.9, 0.1, 0.1]}
    data = [(k, m, int(i < 100 * r)) for k, rs in rates.items() for m, r in enumerate(rs) for i in range(100)]
    rows = spark.createDataFrame(data, "bin string, m int, y int")
    got = {(r["bin"], r["month"]): r["rank"] for r in interactions.steady_ranks(rows, "bin", "m", "y", 0.3).collect()}
    assert [got["a", m] for m in range(4)] == [1, 1, 1, 1]  # leaps of at most 0.22 of a span of 0.8
    assert [got["c", m] for m in range(4)] == [3, 1, 3, 3]


def test_performance_of_several_scores(spark, scored):
    rows = scored.withColumn("none", F.lit(None).cast("double")).withColumn("seg", F.when(F.col("id") % 2 == 0, "even"))
    got = reports.performance(rows, ["pd", "x", "none"], "y", ["seg"]).collect()
    assert sorted((str(r["seg"]), r["score"]) for r in got) == [("None", "pd"), ("None", "x"), ("even", "pd"), ("even", "x")]
    assert all(r["gini"] > 0.4 for r in got if r["score"] == "pd")
    assert {r["score"] for r in reports.performance(rows, ["pd", "x"], "y").collect()} == {"pd", "x"}
