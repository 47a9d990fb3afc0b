"""Jobs that go in parts: batches of features, key ranges, blocks of attributes; and features as text."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from riskloom.operators import categorical
from riskloom.plans import features
from riskloom.sources import imports
from riskloom.sources.shared import Batches

END = datetime.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def events(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [(None if i % 13 == 0 else i % 9, day + datetime.timedelta(days=i % 50), float(i % 11), None if i % 7 == 0 else "abc"[i % 3]) for i in range(300)]
    return spark.createDataFrame(rows, "id int, t timestamp_ntz, v double, kind string")


def plan(*funcs):
    return features.Plan(features.Entity("id", "t", END, "days"), features.expand(["v"], funcs, [(1, 20), (1, None)]), count="n")


def rows(df):
    return sorted(map(str, df.collect()))


def test_batches_resume(spark, events, tmp_path, monkeypatch):
    """A run that stops after a batch goes on with the next; a changed plan makes only what is new; another version makes all."""
    at, whole = str(tmp_path / "a"), plan("sum", "max", "count")
    made, real = [], features.build

    def counted(rows, part, ids=None):
        if len(made) == 2 and stop:
            raise RuntimeError("lost")
        made.append([p.name for p in part.simple])
        return real(rows, part, ids)

    monkeypatch.setattr(features, "build", counted)
    stop = True
    with pytest.raises(RuntimeError, match="lost"):
        features.build_in_batches(events, whole, at, "v1", size=2)
    stop = False
    assert len(made) == 2
    got = features.build_in_batches(events, whole, at, "v1", size=2)
    assert len(made) == 3 and made[2] == [p.name for p in whole.simple[4:]]
    assert rows(got) == rows(real(events, whole).select(got.columns)) and got.where("id IS NULL").count() == 1
    features.build_in_batches(events, plan("sum", "max", "count", "min"), at, "v1", size=2)
    assert len(made) == 4
    features.build_in_batches(events, whole, at, "v2", size=2)
    assert len(made) == 7


def test_a_part_without_manifest_is_made_again(spark, tmp_path):
    """Files of a part that was cut off do not count, and a failing part is tried again."""
    jobs, calls = Batches(spark, str(tmp_path), tries=2), []
    spark.range(5).write.parquet(str(tmp_path / "p"))

    def make():
        calls.append(1)
        if len(calls) == 1:
            raise OSError("once")
        return spark.range(3)

    assert jobs.do("p", "m", make).count() == 3 and len(calls) == 2
    assert jobs.do("p", "m", make).count() == 3 and len(calls) == 2 and jobs.manifest("p")["rows"] == 3
    with pytest.raises(OSError, match="never"):
        jobs.do("q", "m", lambda: (_ for _ in ()).throw(OSError("never")))
    assert jobs.manifest("q") is None


def test_ranges(spark, tmp_path):
    """Null keys, a key that many rows share, a range that fails, a second version that readers see at the end only."""
    data = [(None if i % 20 == 0 else 7 if i % 3 else i, str(i)) for i in range(400)]
    df = spark.createDataFrame(data, "k int, t string")
    job, read = imports.Import(spark, str(tmp_path / "i"), tries=1), []

    def source(condition):
        read.append(1)
        if len(read) == fails:
            raise OSError("gone")
        return df.where(condition)

    fails = 3
    with pytest.raises(OSError, match="gone"):
        job.ranges(source, "k", 50, "v1", "seen", keys=df)
    assert job.catalogue() is None
    fails, done = 0, len(read)
    got = job.ranges(source, "k", 50, "v1", "seen", keys=df)
    assert rows(got) == rows(df) == rows(spark.table("seen"))
    ranges = len(job.catalogue()["parts"])
    assert 1 < ranges <= 9 and len(read) - done == ranges - 2  # two were there
    again = len(read)
    job.ranges(source, "k", 50, "v1", keys=df)
    assert len(read) == again
    more = df.unionByName(spark.createDataFrame([(999, "new")], df.schema))
    fails = len(read) + 2
    with pytest.raises(OSError, match="gone"):
        job.ranges(source, "k", 50, "v2", "seen", keys=more)
    assert rows(job.table()) == rows(df) == rows(spark.table("seen"))
    assert rows(job.ranges(more, "k", 50, "v2", "seen")) == rows(more) == rows(spark.table("seen"))
    assert not rows(imports.Import(spark, str(tmp_path / "e")).ranges(df.limit(0), "k", 50, "v1"))
    assert imports.key_ranges(df.where("k IS NULL"), "k", 5) == [(None, None)]


def test_blocks(spark, tmp_path):
    facts = spark.createDataFrame([(1, "a", 1, "x"), (1, "a", 2, "y"), (1, "b", 1, "z"), (2, "b", 1, None), (None, "c", 1, "n")], "id int, attribute string, phase int, v string")
    made = imports.Import(spark, str(tmp_path)).blocks(facts, [("a", "first", "one"), ("b", "second", "one"), ("c", "third", "two")], "id", "attribute", "phase", ["v"], "v1")
    assert rows(made["one"]) == ["Row(id=1, first='y', second='z')", "Row(id=2, first=None, second=None)"] and rows(made["two"]) == ["Row(id=None, third='n')"]


def test_categorical_text(spark, events):
    """The text gives what the plan gives, in Spark and in another engine; ties, nulls and entities without rows in range."""
    entity = features.Entity("id", "t", END, "days")
    aged = events.withColumns({"_age": entity.age().cast("long"), "w": F.col("v").cast("long")})
    aged.createOrReplaceTempView("aged_events")
    funcs = [*categorical.ONE_PASS, *categorical.TWO_LEVEL, *categorical.ORDERED]
    text = categorical.sql_text("aged_events", "id", "kind", funcs, "w", "t", 1, 30, ("w", "kind"))
    got = spark.sql(text)
    inside = aged.where("_age <= 30 AND kind IS NOT NULL")
    plain = categorical.simple(inside, ["id"], "kind", "t", "w")
    totals = categorical.by_total(inside, ["id"], "kind", "w")
    moved = categorical.changes(inside, ["id"], "kind", "t", entity.end(), "days", ("w", "kind"))
    want = {}
    for df in (plain, totals, moved):
        for r in df.collect():
            want.setdefault(r["id"], []).extend(r[1:])
    mine = {r["id"]: list(r[1:]) for r in got.collect()}
    assert {k: [None if v == 0 and i == len(funcs) - 2 else v for i, v in enumerate(x)] for k, x in mine.items() if k in want} == {k: [None if v == 0 and i == len(funcs) - 2 else v for i, v in enumerate(x)] for k, x in want.items()}
    c = duckdb.connect()
    c.register("aged_events", aged.toArrow())
    theirs = {r[0]: list(r[1:]) for r in c.execute(text).fetchall()}
    assert theirs == mine
    with pytest.raises(ValueError, match="unknown"):
        categorical.sql_text("t", "id", "kind", ["median"])
