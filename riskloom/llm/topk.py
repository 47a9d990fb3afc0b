"""Exact top-k by inner product: no-random-access aggregation over sorted lists, in blocks of rows.

Rows are cut into blocks. In a block every dimension has one list of the rows sorted by their component; a query reads it from
its high end where its own component is positive and from its low end where it is negative. Reading goes down all lists
together, segment by segment, and nothing but the lists is read. What a row has in the segments read so far counts as it is;
what it has not shown yet lies between the last value read (upper bound) and the end of the list (lower bound). A query goes on
until rows that it has not met cannot qualify, then until few of the met ones can; their scores are then resolved.

The k-th score so far begins with exact scores over a bounded sample and grows with lower bounds; it only ever excludes rows,
so every block gives its part of the exact answer whatever the sample is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import Tables

#: Components of the rows of a block (8,192 rows of 64), and queries of a block.
COMPONENTS, QUERIES = 1 << 19, 4_096
#: Rows of the sample (least hash) that gives the first k-th scores, and the most components that such a row has.
SAMPLE, WIDEST = 2_048, 1_024
#: Shares of the lists after which bounds are looked at.
DEPTHS = (1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 1)
#: Queries whose bounds are held at once, and the share of a block's rows that is few enough to be resolved.
SLICE, FEW = 256, 1 / 16
#: Sums below it are exact in doubles.
_EXACT = 2.0**53


def _numbers(rows: list, most: float) -> np.ndarray:
    """Doubles where every sum of products is exact in them, else Python integers."""
    x = np.stack(rows).astype(np.float64)
    return x if most * max(1, x.shape[1]) < _EXACT else np.array([[int(c) for c in row] for row in x], object)


class Lists:
    """The sorted lists of a block, both ends of each, and what has been read of them."""

    def __init__(self, x: np.ndarray):
        self.x, (self.n, self.dim) = x, x.shape
        order = np.argsort(x, axis=0, kind="stable")
        self.lists = np.concatenate([order[::-1], order], axis=1)  # n x 2 dim: from the high ends, then from the low ones
        self.seen = np.zeros((2 * self.dim, self.n), bool)
        self.value = np.zeros((2 * self.dim, self.n), x.dtype)
        self.depth = 0
        self.worst = self._at(self.n - 1)

    def _at(self, depth: int) -> np.ndarray:
        both = self.lists[depth]
        return self.x[both, np.tile(np.arange(self.dim), 2)]

    def read(self, depth: int) -> None:
        """Reads every list down to ``depth`` rows."""
        for j in range(2 * self.dim):
            rows = self.lists[self.depth : depth, j]
            self.seen[j, rows] = True
            self.value[j, rows] = self.x[rows, j % self.dim]
        self.depth = depth
        self.last = self._at(depth - 1)

    def highest(self) -> np.ndarray:
        """What each list gives a row at most: its value where it was read, else the last value read."""
        return np.where(self.seen, self.value, self.last[:, None])

    def lowest(self, rows: np.ndarray | slice) -> np.ndarray:
        """What each list gives these rows at least: the value read, else the end of the list."""
        return np.where(self.seen[:, rows], self.value[:, rows], self.worst[:, None])


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of different ids, ties to the smaller one."""
    order = np.lexsort((ids, -scores)) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), np.int64)
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)[:k]]
    return scores[order], ids[order]


def _kth(scores: np.ndarray, ids: np.ndarray, k: int) -> float:
    """The k-th best score of different ids."""
    best = _best(scores, ids, k)[0]
    return best[k - 1] if len(best) == k else -np.inf


def aggregate(q: np.ndarray, own: np.ndarray, least: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its number, and scores and ids of the rows of this block that can be among its k best.

    ``least`` are scores that k other ids reach somewhere; rows of the query's own id take no part.
    """
    weights = np.concatenate([np.where(q > 0, q, 0), np.where(q < 0, q, 0)], axis=1)
    lists, least, open_ = Lists(x), least.astype(q.dtype), np.arange(len(q))
    for share in DEPTHS:
        depth = max(1, int(lists.n * share))
        if depth == lists.depth and share < 1:
            continue
        lists.read(lists.n if share == 1 else depth)
        unknown = open_[np.array(least[open_] == -np.inf, bool)]  # no k-th score yet: lower bounds give one
        low = lists.lowest(slice(None)) if len(unknown) and share < 1 and lists.n > k else None
        for at in range(0, len(unknown) if low is not None else 0, SLICE):
            part = unknown[at : at + SLICE]
            for number, bound in zip(part.tolist(), weights[part] @ low, strict=True):
                least[number] = _kth(bound[ids != own[number]], ids[ids != own[number]], k)
        out = weights[open_] @ lists.last < least[open_]  # rows that were not met cannot qualify
        ready, rest = (open_, open_[:0]) if share == 1 else (open_[out], open_[~out])
        high, left = None, []
        for at in range(0, len(ready), SLICE):
            part = ready[at : at + SLICE]
            high = lists.highest() if high is None else high
            bounds = weights[part] @ high
            for number, bound in zip(part.tolist(), bounds, strict=True):
                able = np.flatnonzero((bound >= least[number]) & (ids != own[number]))
                if len(able) > k and share < 1:  # the lower bounds of the most hopeful rows may lift the k-th score
                    hope = able[np.argsort(-bound[able])[: 4 * k]]
                    least[number] = max(least[number], _kth(weights[number] @ lists.lowest(hope), ids[hope], k))
                    able = able[bound[able] >= least[number]]
                if share == 1 or len(able) <= max(4 * k, FEW * lists.n):
                    yield number, *_best(x[able] @ q[number], ids[able], k)
                else:
                    left.append(number)
        open_ = np.concatenate([rest, np.array(left, np.int64)])
        if not len(open_):
            return


def search(rows: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest inner products of floor(scale * component), ties to the smaller id.

    Rows and queries with a null id or vector, or a null or non-finite component, take no part; zero vectors do. A query's
    candidates are the rows of another id with as many components. Repeated rows count once; an id with several vectors
    counts once, with the best of its scores. Empty tables give no rows. A score beyond 64 bits is an error.
    """
    spark = rows.sparkSession
    tables = Tables(spark)
    big = F.lit(float("inf"))
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < big)

    def whole(df: DataFrame) -> DataFrame:
        numbers = F.transform("v", lambda c: F.when(F.abs(c * scale) < _EXACT, F.floor(c * scale).cast("double")).otherwise(c * scale))
        df = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        df = df.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine)).withColumn("v", numbers)
        return df.dropDuplicates(["id", "v"]).withColumn("dim", F.size("v"))

    table = tables.put(whole(rows), "rows")
    asked = tables.put(whole(queries), "asked")
    held, many = table.agg(F.sum(F.greatest(F.col("dim"), F.lit(1)))).first()[0], asked.count()
    shape = "query_id long, rank int, vec_id long, score long"
    if not held or not many:
        return spark.createDataFrame([], shape)
    blocks, groups = -(-held // COMPONENTS), -(-many // QUERIES)
    sample = table.where(F.col("dim") <= WIDEST).orderBy(F.xxhash64("id", "v")).limit(SAMPLE).select("id", "v", "dim").toArrow().to_pandas()
    first = spark.sparkContext.broadcast({dim: (s["id"].to_numpy(), np.stack(s["v"])) for dim, s in sample.groupby("dim")})

    def begun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries with the k-th score over the sample: -inf where it is not known."""
        for batch in batches:
            out = np.full(len(batch), -np.inf)
            for i, (own, v) in enumerate(zip(batch["id"], batch["v"], strict=True)):
                ids, x = first.value.get(len(v), (None, None))
                if ids is not None and np.abs(x).max(initial=1) * np.abs(v).max(initial=1) * max(1, len(v)) < _EXACT:
                    out[i] = _kth(x[ids != own] @ v, ids[ids != own], k)
            yield batch.assign(least=out)

    def met(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(block):
            most = max(abs(np.stack(asked["v"])).max(initial=1), 1.0) * max(abs(np.stack(block["v"])).max(initial=1), 1.0)
            q, x = _numbers(list(asked["v"]), most), _numbers(list(block["v"]), most)
            own, ids, least = asked["id"].to_numpy(), block["id"].to_numpy(), asked["least"].to_numpy()
            for number, scores, near in aggregate(q, own, least, x, ids, k):
                out += [(int(own[number]), int(i), int(s)) for s, i in zip(scores, near, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    asked = tables.put(asked.mapInPandas(begun, "id long, v array<double>, dim int, least double"), "begun")
    spread = lambda n, seed: F.pmod(F.xxhash64("id", "v", F.lit(seed)), F.lit(n))
    left = asked.withColumn("group", spread(groups, 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    right = table.withColumn("block", spread(blocks, 2)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    cell = ["dim", "group", "block"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(met, "query_id long, vec_id long, score long")
    found = tables.put(found, "found")
    for name in ("rows", "asked", "begun"):
        tables.drop(name)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, [floor(256 * c::DOUBLE) FOR c IN embedding] AS x FROM embeddings WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
scored AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
