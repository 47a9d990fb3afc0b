"""Every registered query against its SQL on the smallest tables, and those without SQL for their shape."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.plans import catalogue
from riskloom.streaming import events as streams

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(frame, columns):
    def value(v):
        if v is None or v is pd.NA or v != v or str(v) in ("NaT", "<NA>"):
            return "null"
        if isinstance(v, bool) or type(v).__name__.startswith("bool"):
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            try:
                return f"{float(v):.5f}"
            except (TypeError, ValueError):
                pass
        return str(v)

    return sorted(tuple(value(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.fixture(scope="session")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, D).toPandas()
    assert len(got) or name in catalogue.ORACLES  # a difference may be empty, as its SQL then is
    if name in catalogue.ORACLES:
        want = db.execute(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        mine, theirs = rows(got, sorted(got.columns)), rows(want, sorted(got.columns))
        assert len(mine) == len(theirs)
        near = lambda a, b: a == b or (a.replace(".", "").replace("-", "").isdigit() and b.replace(".", "").replace("-", "").isdigit() and abs(float(a) - float(b)) < 2e-5)
        assert all(near(x, y) for r, s in zip(mine, theirs, strict=True) for x, y in zip(r, s, strict=True))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.ORACLES) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_gives_the_batch_result(spark, tmp_path):
    events = spark.read.parquet(f"{D}/events.parquet")
    events.orderBy("ts").repartition(1).write.parquet(str(tmp_path / "in"))
    stream = streams.tumbling(streams.read_stream(spark, str(tmp_path / "in"), events.schema), "user_id", "ts", "value", "1 day", "1 hour")
    streams.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    done = spark.read.parquet(str(tmp_path / "out"))
    batch = streams.tumbling(events, "user_id", "ts", "value", "1 day", "1 hour")
    last = events.agg(F.max("ts")).first()[0]
    assert done.count() > 0 and done.join(batch, ["user_id", "window_start", "n"]).count() == done.count() and last is not None
