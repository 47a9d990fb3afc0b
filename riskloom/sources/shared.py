"""Tables in the folder that all executors share: they cut lineage, and finished parts of a longer job are found again."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder of a local session (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="riskloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fingerprint(*parts: object) -> str:
    """A short name for what a piece of work depends on."""
    return hashlib.sha256("\x00".join(map(str, parts)).encode()).hexdigest()[:16]


class Scratch:
    """Intermediate tables of one job."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.names = spark, f"{folder(spark)}/scratch-{uuid.uuid4().hex}", []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, keep: Iterable[str] = ()) -> None:
        for name in set(self.names) - set(keep):
            Files(self.spark).remove(f"{self.root}/{name}")


class Files:
    """The few file operations a manifest needs, on whatever store the path names."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def remove(self, path: str) -> None:
        store, p = self._at(path)
        store.delete(p, True)

    def write(self, path: str, text: str) -> None:
        """All or nothing: a file beside it, then its rename."""
        store, p = self._at(path)
        beside = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        out = store.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        store.delete(p, False)
        if not store.rename(beside, p):
            raise OSError(f"cannot rename to {path}")

    def read(self, path: str) -> str | None:
        store, p = self._at(path)
        if not store.exists(p):
            return None
        source = store.open(p)
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()


class Batches:
    """A job in named parts, each written once under ``root``; a manifest beside each says that it is whole.

    A part is done if its manifest names the same fingerprint. Another fingerprint, or a part that was cut off, is written
    over. A part that fails is tried again ``tries`` times before the job stops; finished parts stay for the next run.
    """

    def __init__(self, spark: SparkSession, root: str, tries: int = 1):
        self.spark, self.root, self.tries, self.ran = spark, root.rstrip("/"), tries, []
        self.files = Files(spark)

    def manifest(self, name: str) -> dict | None:
        text = self.files.read(f"{self.root}/{name}.json")
        return json.loads(text) if text else None

    def finished(self, name: str, mark: str) -> bool:
        return (self.manifest(name) or {}).get("fingerprint") == mark

    def do(self, name: str, mark: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The part's table: written by ``make`` unless it is there already."""
        path = f"{self.root}/{name}"
        if not self.finished(name, mark):
            self.files.remove(f"{path}.json")
            for left in range(self.tries, 0, -1):
                try:
                    made = make()
                    made.write.mode("overwrite").parquet(path)
                    break
                except Exception:
                    if left == 1:
                        raise
            self.ran.append(name)
            self.files.write(f"{path}.json", json.dumps({"fingerprint": mark, "schema": made.schema.json(), "rows": self.spark.read.schema(made.schema).parquet(path).count()}))
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(json.loads(self.manifest(name)["schema"]))).parquet(path)
