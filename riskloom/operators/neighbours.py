"""Weights of one population by how dense another is around each of its rows: an exact radius join over cells.

Equal rows fold into points with counts. A bounded sample of points are pivots; each point belongs to the nearest, its cell,
and a cell is known by its pivot, its reach and its count. The distance to the k-th neighbour is bounded first: by the points
of the own block, and by the reach of whole cells. Then a point visits only the cells that the bound does not exclude, for its
exact k-th distance and for the count of targets inside it. Cells inside the radius are counted unvisited. Visits carry a
point to a cell, no pair of points is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.sources.shared import Scratch

#: Points to a pivot, the most pivots, and the points and visitors of one task.
CELL, PIVOTS, BLOCK = 2_000, 16_384, 4_096
#: Distances that are held at once.
HELD = 1 << 20


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed in the order of the columns, so equal rows give equal bits everywhere."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        step = a[:, j, None] - b[None, :, j]
        out += step * step
    return out


def _slices(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    step = max(1, HELD // max(1, len(b)))
    for at in range(0, len(a), step):
        yield at, _squares(a[at : at + step], b)


def _kth(squares: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Per row the least square that k copies reach; inf where there are fewer."""
    order = np.argsort(squares, axis=1, kind="stable")
    reached = np.cumsum(counts[order], axis=1) >= k
    first = reached.argmax(1)
    found = squares[np.arange(len(squares)), order[np.arange(len(squares)), first]]
    return np.where(reached.any(1), found, np.inf)


class _Cells:
    """What all tasks know: the pivots and, of each cell of sources and targets, reach, count and number of blocks."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.facts = pivots, {}

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell, far = np.empty(len(x), np.int64), np.empty(len(x))
        for at, d in _slices(x, self.pivots):
            cell[at : at + len(d)] = d.argmin(1)
            far[at : at + len(d)] = np.sqrt(d.min(1))
        return cell, far

    def know(self, side: str, points: DataFrame) -> None:
        reach, count, blocks = np.full(len(self.pivots), -np.inf), np.zeros(len(self.pivots), np.int64), np.ones(len(self.pivots), np.int64)
        for r in points.groupBy("cell").agg(F.max("far").alias("far"), F.sum("copies").alias("n"), F.count("*").alias("points")).collect():  # one row a pivot at most
            reach[r["cell"]], count[r["cell"]], blocks[r["cell"]] = r["far"], r["n"], -(-r["points"] // BLOCK)
        self.facts[side] = (reach, count, blocks)


def radius_weights(source: DataFrame, target: DataFrame, columns: Sequence[str], k: int = 50, normalize: bool = True, name: str = "weight") -> DataFrame:
    """``source`` with ``name``: the target rows no farther than the row's k-th nearest source row, itself among the k.

    Distances are Euclidean, over columns that ``normalize`` shifts and scales by the source's mean and deviation (population
    form; a constant column is only shifted). Rows that hold a null, NaN or infinite value in a column take no part: sources
    of that kind get null, as do all where fewer than k sources are left. Ties at the radius count. Equal rows each count.
    """
    spark = source.sparkSession
    scratch = Scratch(spark)
    value = {c: F.col(c).cast("double") for c in columns}
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    if normalize:
        whole = source.where(reduce(Column.__and__, [fine(x) for x in value.values()]))
        facts = whole.agg(*[f(x).alias(f"_{i}_{n}") for i, x in enumerate(value.values()) for n, f in (("mean", F.avg), ("deviation", F.stddev_pop))]).first()
        value = {c: (x - (facts[2 * i] or 0.0)) / (facts[2 * i + 1] or 1.0) for i, (c, x) in enumerate(value.items())}
    vector = F.array(*[x + 0.0 for x in value.values()])
    usable = F.forall(vector, fine)
    fold = lambda df: df.where(usable).groupBy(vector.alias("v")).agg(F.count("*").alias("copies"))

    points = scratch.put(fold(source), "source-points")
    others = scratch.put(fold(target), "target-points")
    many, rows = points.agg(F.count("*"), F.sum("copies")).first()
    if (rows or 0) < k:
        return source.withColumn(name, F.lit(None).cast("long"))
    few = points.orderBy(F.xxhash64("v"), "v").limit(int(min(PIVOTS, -(-many // CELL)))).select("v").toPandas()["v"]
    cells = _Cells(np.stack(few).astype(np.float64))
    pivots = spark.sparkContext.broadcast(cells.pivots)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filter(len, batches):
            cell, far = _Cells(pivots.value).nearest(np.stack(b["v"]))
            yield b.assign(cell=cell, far=far)

    shape = "v array<double>, copies long, cell long, far double"
    points = scratch.put(points.mapInPandas(placed, shape), "sources")
    others = scratch.put(others.mapInPandas(placed, shape), "targets")
    cells.know("source", points)
    cells.know("target", others)
    known = spark.sparkContext.broadcast(cells)

    def blocked(df: DataFrame, side: str) -> DataFrame:
        counts = cells.facts[side][2]
        several = [F.lit(int(x)) for c in np.flatnonzero(counts > 1) for x in (c, counts[c])]  # one pair a pivot at most
        of = F.coalesce(F.create_map(*several)[F.col("cell")], F.lit(1)) if several else F.lit(1)
        return df.withColumn("block", F.pmod(F.xxhash64("v"), of).cast("long"))

    def bounded(block: pd.DataFrame) -> pd.DataFrame:
        """The k-th square inside the own block, or within whole cells."""
        x, copies = np.stack(block["v"]), block["copies"].to_numpy()
        reach, count, _ = known.value.facts["source"]
        bound = np.empty(len(x))
        for at, s in _slices(x, x):
            bound[at : at + len(s)] = _kth(s, copies, k)
        for at, s in _slices(x, known.value.pivots):
            part = bound[at : at + len(s)]
            part[:] = np.minimum(part, _kth(((np.sqrt(s) + reach) * (1 + 1e-9)) ** 2, count, k))
        return pd.DataFrame({"v": block["v"], "bound": bound})

    def visits(side: str, radius: str):
        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reach, count, blocks = known.value.facts[side]
            for b in filter(len, batches):
                for at, s in _slices(np.stack(b["v"]), known.value.pivots):
                    part = b.iloc[at : at + len(s)]
                    far, r = np.sqrt(s), np.sqrt(part[radius].to_numpy())[:, None]
                    inside = (far + reach) * (1 + 1e-9) <= r if side == "target" else np.zeros(far.shape, bool)
                    inside &= count > 0
                    i, c = np.nonzero((count > 0) & ~inside & ((far - reach) * (1 - 1e-9) - 1e-9 * far <= r))
                    n = blocks[c]
                    block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    yield pd.DataFrame({"v": part["v"].to_numpy()[np.repeat(i, n)], "radius": part[radius].to_numpy()[np.repeat(i, n)], "cell": np.repeat(c, n), "block": block, "n": 0})
                    got = np.flatnonzero(inside.any(1))
                    yield pd.DataFrame({"v": part["v"].to_numpy()[got], "radius": part[radius].to_numpy()[got], "cell": -1, "block": 0, "n": (inside * count).sum(1)[got]})

        return go

    def met(df: DataFrame, side: str, radius: str, held: DataFrame, meet, schema: str) -> tuple[DataFrame, DataFrame]:
        """What meets by cell, block and a share of the visitors, which are counted first; and the counts of whole cells."""
        went = scratch.put(df.mapInPandas(visits(side, radius), "v array<double>, radius double, cell long, block long, n long"), f"visits-{side}")
        goes = went.where("cell >= 0")
        shares = goes.groupBy("cell", "block").agg(F.ceil(F.count("*") / BLOCK).alias("shares"))
        goes = goes.join(shares, ["cell", "block"]).withColumn("share", F.pmod(F.xxhash64("v", F.lit(1)), F.col("shares")))
        hosts = blocked(held, side).join(shares, ["cell", "block"]).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
        by = ["cell", "block", "share"]
        out = goes.select(*by, "v", "radius").groupBy(*by).cogroup(hosts.select(*by, "v", "copies").groupBy(*by)).applyInPandas(meet, schema)
        return out, went.where("cell < 0").select("v", "n")

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Of each visitor the squares of this block that can be among its k least, with their counts."""
        out = []
        if len(a) and len(b):
            x, y, copies, limit = np.stack(a["v"]), np.stack(b["v"]), b["copies"].to_numpy(), a["radius"].to_numpy()
            for at, s in _slices(x, y):
                for i, row in enumerate(s):
                    able = np.flatnonzero(row <= limit[at + i])
                    able = able[np.argsort(row[able], kind="stable")]
                    able = able[: np.searchsorted(np.cumsum(copies[able]), k) + 1]
                    out.append((a["v"].iloc[at + i], row[able], copies[able]))
        return pd.DataFrame(out, columns=["v", "squares", "counts"], dtype=object)

    def inside(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not (len(a) and len(b)):
            return pd.DataFrame({"v": pd.Series([], dtype=object), "n": pd.Series([], dtype="int64")})
        x, y, copies, limit = np.stack(a["v"]), np.stack(b["v"]), b["copies"].to_numpy(), a["radius"].to_numpy()
        n = np.concatenate([((s <= limit[at : at + len(s), None]) * copies).sum(1) for at, s in _slices(x, y)])
        return pd.DataFrame({"v": a["v"].to_numpy(), "n": n})

    bounds = blocked(points, "source").groupBy("cell", "block").applyInPandas(bounded, "v array<double>, bound double")
    found, _ = met(bounds, "source", "bound", points, near, "v array<double>, squares array<double>, counts array<long>")
    pairs = found.select("v", F.explode(F.arrays_zip("squares", "counts")).alias("p")).select("v", "p.squares", "p.counts")
    # At most k entries of a block a visitor; equal squares fold before they are gathered.
    pairs = pairs.groupBy("v", "squares").agg(F.sum("counts").alias("counts")).groupBy("v").agg(F.sort_array(F.collect_list(F.struct("squares", "counts"))).alias("p"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("at"))
    kth = F.aggregate("p", start, lambda a, x: F.when(a["n"] >= k, a).otherwise(F.struct((a["n"] + x["counts"]).alias("n"), x["squares"].alias("at"))))["at"]
    radii = scratch.put(pairs.select("v", kth.alias("radius")), "radii")
    counted, wholes = met(radii, "target", "radius", others, inside, "v array<double>, n long")
    sums = counted.unionByName(wholes).groupBy("v").agg(F.sum("n").alias("n"))
    weights = scratch.put(radii.select("v").join(sums, "v", "left").select(F.col("v").alias("_v"), F.coalesce("n", F.lit(0)).alias(name)), "weights")
    scratch.drop(keep=["weights"])
    kept = source.drop(name).withColumn("_at", F.when(usable, vector))
    return kept.join(weights, F.col("_at") == F.col("_v"), "left").drop("_at", "_v")

