"""Reading and writing: CSV, Parquet, JDBC, cached SQL, name rules, attribute catalogues, attribute-value tables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bounds of whole-number types, smallest first.
INTEGERS = (("tinyint", -(2**7), 2**7), ("smallint", -(2**15), 2**15), ("int", -(2**31), 2**31), ("bigint", -(2**63), 2**63))


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str | None = None, sample: float = 1.0) -> DataFrame:
    """CSV files with a header; without a schema it is inferred from a share of the rows. NaN texts are nulls."""
    reader = spark.read.option("header", True).option("nanValue", "NaN")
    return reader.schema(schema).csv(paths) if schema else reader.option("inferSchema", True).option("samplingRatio", sample).csv(paths)


def read_parts(spark: SparkSession, paths: Sequence[str], schema: StructType | str | None = None) -> DataFrame:
    """Part files of one schema as one table; columns are matched by name."""
    out = read_csv(spark, paths[0], schema)
    for p in paths[1:]:
        out = out.unionByName(read_csv(spark, p, schema), allowMissingColumns=True)
    return out


def read_sql(spark: SparkSession, sql: str, cache: str, refresh: bool = False) -> DataFrame:
    """The result of a statement, kept as Parquet under the hash of its text in a folder that all executors share."""
    path = f"{cache.rstrip('/')}/{hashlib.sha512(sql.encode()).hexdigest()}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if refresh or not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        spark.sql(sql).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table by ranges of a key, in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options).load()


def table_names(columns: Sequence[str], limit: int = 30) -> list[str]:
    """Lower-case names of at most ``limit`` letters, each once."""
    out: list[str] = []
    for c in columns:
        name, k = c.lower()[:limit], 0
        while name in out:
            k += 1
            name = f"{c.lower()[: limit - len(str(k)) - 1]}_{k}"
        out.append(name)
    return out


def write_table(df: DataFrame, name: str, by: Sequence[str] = (), mode: str = "errorifexists", path: str | None = None) -> None:
    """A table, partitioned by columns of few values; managed, or with its files at ``path``."""
    out = df.toDF(*table_names(df.columns)).write.mode(mode)
    out = out.option("path", path) if path else out
    (out.partitionBy(*[b.lower() for b in by]) if by else out).saveAsTable(name)


def suggest_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, type: the least type that holds a column's whole numbers, float where it keeps the distinct count."""
    whole = [c for c in columns if dict(df.dtypes)[c] in ("tinyint", "smallint", "int", "bigint")]
    real = [c for c in columns if dict(df.dtypes)[c] in ("float", "double")]
    stats = df.agg(*[F.struct(F.min(c).cast("long").alias("a"), F.max(c).cast("long").alias("b")).alias(c) for c in whole], *[(F.countDistinct(F.col(c).cast("float")) == F.countDistinct(c)).alias(c) for c in real])
    out = []
    for c in columns:
        kind = F.lit(dict(df.dtypes)[c])
        if c in whole:
            kind = F
            for name, low, high in INTEGERS[:-1]:
                kind = kind.when((F.col(c)["a"] >= low) & (F.col(c)["b"] < high), F.lit(name))
            kind = kind.otherwise(F.lit("bigint"))
        elif c in real:
            kind = F.when(F.col(c), F.lit("float")).otherwise(F.lit("double"))
        out.append(F.struct(F.lit(c).alias("column"), kind.alias("type")))
    return stats.select(F.explode(F.array(*out)).alias("x")).select("x.*")


def import_catalogue(attributes: DataFrame, path: str, families: Sequence[tuple[str, Callable[[Column], Column]]], renames: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Of each dotted path: its parts, its depth ([] counted), its family (the last that fits), a name, a block."""
    c = F.col(path)
    family: Column = F.lit(None).cast("string")
    for name, fits in families:
        family = F.when(fits(c), F.lit(name)).otherwise(family)
    label = c
    for pattern, new in renames:
        label = F.regexp_replace(label, pattern, new)
    depth = F.regexp_count(c, F.lit(r"\[\]"))
    return attributes.select("*", F.split(c, r"\.").alias("parts"), depth.alias("depth"), family.alias("family"), label.alias("name")).withColumn("block", F.concat_ws("_", F.coalesce("family", F.lit("other")), F.col("depth").cast("string")))


def save_catalogue(catalogue: DataFrame, path: str) -> None:
    """A catalogue as CSV with a header, for flagging by hand; lists are JSON text, nulls stand apart from empty text."""
    kinds = dict(catalogue.dtypes)
    flat = [F.to_json(c).alias(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c) for c in catalogue.columns]
    catalogue.select(*flat).write.mode("overwrite").option("header", True).option("nullValue", "\\N").option("emptyValue", "").csv(path)


def load_catalogue(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``save_catalogue`` wrote, with the schema it had and in the order of its columns."""
    flat = ", ".join(f"`{f.name}` {'string' if f.dataType.typeName() in ('array', 'map', 'struct') else f.dataType.simpleString()}" for f in schema)
    rows = spark.read.schema(flat).option("header", True).option("nullValue", "\\N").option("emptyValue", "").csv(path)
    return rows.select(*[F.from_json(f.name, f.dataType.simpleString()).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in schema])


def attribute_profile(facts: DataFrame, key: str, attribute: str, values: Sequence[str]) -> DataFrame:
    """Per attribute: distinct entities and filled values of each kind, in one aggregation."""
    return facts.groupBy(attribute).agg(F.countDistinct(key).alias("n_entities"), *[F.count(v).alias(f"n_{v}") for v in values])


def pivot_attributes(facts: DataFrame, key: str, attribute: str, phase: str, values: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Attribute-value rows as one row per entity: values of the last phase of each (entity, attribute), as text.

    One aggregation by (entity, attribute) picks the last phase; of several values in it the largest stays.
    """
    text = F.coalesce(*[F.col(v).cast("string") for v in values])
    last = facts.groupBy(key, attribute).agg(F.max(F.struct(F.col(phase).alias("p"), text.alias("v")))["v"].alias("_v"))
    return last.groupBy(key).pivot(attribute, list(names)).agg(F.max("_v"))


def attributes_of(name: str) -> list[str]:
    """Placeholders of a path, such as group positions."""
    return re.findall(r"\[([^\]]*)\]", name)
