"""Imports of tables too large for one read: key ranges and blocks of attributes, each written once, shown when all are there."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.shared import Batches, Files, fingerprint
from riskloom.sources.tables import pivot_attributes

#: The most ranges of one import: their bounds are a list on the driver; ranges then hold more rows instead.
RANGES = 10_000


def key_ranges(rows: DataFrame, key: str, size: int, sample: float = 1.0) -> list[tuple]:
    """(low, high) of ranges of about ``size`` rows, low included; None where a range is open. Nulls go with the first.

    Bounds are approximate quantiles of the key, of a share of the rows if ``sample`` is below 1: they decide how even the
    ranges are, never what is in them. A key that many rows share is one range, as no bound divides it.
    """
    some = rows.select(key) if sample >= 1 else rows.select(key).sample(sample, seed=1)
    n = some.count() / min(1.0, sample)
    parts = min(RANGES, max(1, -(-int(n) // size)))
    shares = [i / parts for i in range(1, parts)]
    cuts = some.agg(F.percentile_approx(key, F.array(*map(F.lit, shares)), F.lit(max(10_000, 10 * parts))).alias("c")).first()["c"] if shares else None
    ends = [None, *sorted(set(cuts or [])), None]
    return list(zip(ends, ends[1:], strict=False))


def within(key: str, low: object, high: object) -> Column:
    inside = F.lit(True) if low is None else F.col(key) >= F.lit(low)
    inside = inside if high is None else inside & (F.col(key) < F.lit(high))
    return F.coalesce(inside, F.lit(False)) if low is not None else F.col(key).isNull() | F.coalesce(inside, F.lit(True))


class Import:
    """What an import's folder holds: one folder a version, and a catalogue that names the version readers see."""

    def __init__(self, spark: SparkSession, root: str, tries: int = 2):
        self.spark, self.root, self.tries, self.files = spark, root.rstrip("/"), tries, Files(spark)
        self.ran: list[str] = []

    def catalogue(self) -> dict | None:
        text = self.files.read(f"{self.root}/catalogue.json")
        return json.loads(text) if text else None

    def _batches(self, version: str) -> Batches:
        return Batches(self.spark, f"{self.root}/{fingerprint(version)}", self.tries)

    def _show(self, version: str, parts: dict[str, str], view: str | None) -> None:
        """The new version becomes the one that is read; then the one before it goes."""
        before = self.catalogue()
        self.files.write(f"{self.root}/catalogue.json", json.dumps({"version": version, "folder": fingerprint(version), "parts": parts}))
        if view:
            self.table().createOrReplaceTempView(view)
        if before and before["folder"] != fingerprint(version):
            self.files.remove(f"{self.root}/{before['folder']}")

    def table(self, block: str | None = None) -> DataFrame:
        """All parts of the shown version, or those of one block."""
        now = self.catalogue()
        names = [n for n, b in now["parts"].items() if block is None or b == block]
        batches = self._batches(now["version"])
        schema = batches.do(names[0], batches.manifest(names[0])["fingerprint"], lambda: None).schema
        return self.spark.read.schema(schema).parquet(*[f"{batches.root}/{n}" for n in names])

    def ranges(self, source: DataFrame | Callable[[Column], DataFrame], key: str, size: int, version: str, view: str | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The source by ranges of its key, each a job and a folder of its own.

        ``source`` is a table, or a function of a condition that reads its rows (with ``keys``, a table of the keys). What an
        earlier run of the version finished is not read again; a range that fails is tried again, then the import stops and
        readers keep the version before. The view is replaced at the end.
        """
        read = source.where if isinstance(source, DataFrame) else source
        batches, at = self._batches(version), f"{self.root}/{fingerprint(version)}/ranges.json"
        text = self.files.read(at)
        found = json.loads(text) if text else None
        if not found or found["of"] != [key, size]:
            from_rows = keys if keys is not None else read(F.lit(True))
            found = {"of": [key, size], "bounds": key_ranges(from_rows, key, size)}
            self.files.write(at, json.dumps(found, default=str))
        bounds = [tuple(b) for b in found["bounds"]]
        names = {}
        for i, (low, high) in enumerate(bounds):
            name = f"range-{i:05d}"
            batches.do(name, fingerprint(key, low, high), lambda low=low, high=high: read(within(key, low, high)))
            names[name] = ""
        self.ran = batches.ran
        self._show(version, names, view)
        return self.table()

    def blocks(self, facts: DataFrame, catalogue: Sequence[tuple[str, str, str]], key: str, attribute: str, phase: str, values: Sequence[str], version: str) -> dict[str, DataFrame]:
        """Attribute-value rows as one wide table a block of the catalogue, rows of (attribute, name, block).

        Each block reads its own attributes only; ``facts`` should be partitioned by the attribute or its block.
        """
        batches, names = self._batches(version), {}
        for block in dict.fromkeys(b for _, _, b in catalogue):
            own = [(a, n) for a, n, b in catalogue if b == block]

            def make(own=own) -> DataFrame:
                wide = pivot_attributes(facts.where(F.col(attribute).isin(*[a for a, _ in own])), key, attribute, phase, values, [a for a, _ in own])
                return wide.select(key, *[F.col(f"`{a}`").alias(n) for a, n in own])

            batches.do(f"block-{fingerprint(block)}", fingerprint(own), make)
            names[f"block-{fingerprint(block)}"] = block
        self.ran = batches.ran
        self._show(version, names, None)
        return {b: self.table(b) for b in names.values()}
