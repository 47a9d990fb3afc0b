"""Approximate nearest neighbours: a forest of random-projection trees searched through one shared priority queue.

The forest is fitted on a bounded sample and sent to every task; every row is routed to one leaf of each tree. A query keeps
one queue over all trees, ordered by the least margin on the way, and takes leaves until it has enough candidates. How many
are enough is measured on the sample: so many as give the wanted recall there. Leaves lie in cells, small subtrees; a cell and
the queries that reach a leaf of it are cogrouped, so candidates are reranked by their exact cosine where their vectors are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import Tables

#: Rows the forest is fitted on (least md5 of the id), trees, and sampled rows that a leaf and a cell hold at most.
SAMPLE, TREES, LEAF, CELL = 20_000, 20, 40, 800
#: The recall that the sample is to reach, the sampled queries that measure it, and the rows a query looks at in any case.
RECALL, MEASURED, SEARCH = 0.95, 100, 1_000
#: Rows of a cell that one task holds; larger cells are cut into blocks that every query of the cell visits.
BLOCK = 8_192


@dataclass
class Forest:
    """All trees in flat arrays. A node's child below 0 is leaf number -1 - child; leaf numbers run over all trees."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray  # nodes x 2: left where the margin is below 0
    roots: list[int]
    cells: np.ndarray  # of each leaf

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf numbers, rows x trees."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while (go := np.flatnonzero(at >= 0)).size:
                nodes = at[go]
                right = np.einsum("ij,ij->i", self.normals[nodes], x[go]) + self.offsets[nodes] >= 0
                at[go] = self.children[nodes, right.astype(int)]
            out[:, t] = -1 - at
        return out

    def search(self, q: np.ndarray) -> Iterator[int]:
        """All leaves by the least margin that leads to them, over all trees."""
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        margins, children = (self.normals @ q + self.offsets).tolist(), self.children.tolist()
        while queue:
            worst, node = heapq.heappop(queue)
            while node >= 0:
                margin = margins[node]
                near = margin >= 0
                heapq.heappush(queue, (max(worst, abs(margin)), children[node][not near]))
                node = children[node][near]
            yield -1 - node


def grow(x: np.ndarray, trees: int = TREES, leaf: int = LEAF, cell: int = CELL, seed: int = 7) -> Forest:
    """Split by the plane between two random rows, of unit length, until at most ``leaf`` rows or equal rows are left."""
    rng = np.random.default_rng(seed)
    normals, offsets, children, cells, begun = [], [], [], [], 0

    def split(rows: np.ndarray, own: int | None) -> int:
        nonlocal begun
        if len(rows) > leaf:
            for _ in range(5):
                a, b = x[rng.choice(rows, 2, replace=False)]
                normal = b - a
                if not (size := np.linalg.norm(normal)):
                    continue
                normal /= size
                offset = -float(normal @ (a + b) / 2)
                right = x[rows] @ normal + offset >= 0
                if 0.02 < right.mean() < 0.98:
                    if own is None and len(rows) <= cell:
                        own, begun = begun, begun + 1
                    node = len(normals)
                    normals.append(normal)
                    offsets.append(offset)
                    children.append([0, 0])
                    children[node] = [split(rows[~right], own), split(rows[right], own)]
                    return node
        if own is None:
            own, begun = begun, begun + 1
        cells.append(own)
        return -len(cells)

    roots = [split(np.arange(len(x)), None) for _ in range(trees)]
    dim = x.shape[1]
    return Forest(np.array(normals, np.float64).reshape(-1, dim), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), roots, np.array(cells))


def needed(forest: Forest, x: np.ndarray, k: int, recall: float = RECALL, queries: int = MEASURED) -> float:
    """Rows that a query must hold, counted in each tree, as a share of all rows, for ``recall`` among the sample itself.

    In all rows neighbours are nearer than in the sample, so they are found no later.
    """
    leaves = forest.route(x)
    counts = np.bincount(leaves.ravel(), minlength=len(forest.cells))
    held = []
    for q in range(0, len(x), -(-len(x) // queries)):
        near = x @ x[q]
        near[q] = -np.inf
        left = set(np.argpartition(-near, min(k, len(x) - 1) - 1)[:k].tolist()) - {q}
        homes: dict[int, set[int]] = {}
        for i in left:
            for leaf in leaves[i].tolist():
                homes.setdefault(leaf, set()).add(i)
        total = 0
        for leaf in forest.search(x[q]):
            total += int(counts[leaf])
            found = homes.get(leaf, set()) & left
            held += [total] * len(found)
            left -= found
            if not left:
                break
    return float(np.quantile(held, recall)) / len(x) if held else 1.0


def _usable(vector: str) -> Column:
    """No null, no null or non-finite component, and not zero."""
    big = F.lit(float("inf"))
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < big)
    return F.col(vector).isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda v: v != 0)


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows).astype(np.float64) if len(rows) else np.zeros((0, 1))
    return x / np.sqrt((x * x).sum(1))[:, None]


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL, search: int = SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its ``k`` nearest rows found, other than itself; ties to the smaller id.

    Rows and queries with a null id or an unusable vector take no part, nor do those with another number of components
    than most rows of the sample. Repeated rows count once. An id with several vectors counts once, with the best of its
    scores; a query of that kind takes the best over its vectors. Of rows with one vector only the k + 1 of smallest ids can
    be among a query's nearest, as they tie on the score; the others are left to them, so copies never fill a leaf. Empty
    tables give no rows.
    """
    spark = rows.sparkSession
    tables = Tables(spark)
    kind = rows.schema[vector].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    known = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")).where(F.col("id").isNotNull() & _usable("v"))
    copies = Window.partitionBy(F.md5(F.concat_ws(",", F.transform("v", lambda c: (c + 0.0).cast("string"))))).orderBy("id")
    index = tables.put(known(rows).dropDuplicates(["id", "v"]).withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1).drop("_n"), "index")
    sample = index.orderBy(F.md5(F.col("id").cast("string"))).limit(SAMPLE).select("v").toArrow().to_pandas()["v"]
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = np.array([len(v) for v in sample])
    dim = int(np.bincount(lengths).argmax())
    units = _unit(sample[lengths == dim])
    forest = grow(units)
    shared = spark.sparkContext.broadcast(forest)

    def posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[at : at + 1_000] for b in batches for at in range(0, len(b), 1_000)):
            leaves = shared.value.route(_unit(batch["v"]))
            n = leaves.shape[1]
            yield pd.DataFrame({"cell": shared.value.cells[leaves.ravel()], "leaf": leaves.ravel(), "id": np.repeat(batch["id"].to_numpy(), n), "v": [v for v in batch["v"] for _ in range(n)]})

    fits = F.size("v") == dim
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(shared.value.cells), np.int64)
        for batch in filter(len, batches):
            total += np.bincount(shared.value.route(_unit(batch["v"])).ravel(), minlength=len(total))
        leaf = np.flatnonzero(total)
        yield pd.DataFrame({"leaf": leaf, "n": total[leaf]})

    # Rows are routed again where they are compared: that costs less than a table of them for each tree.
    posts = index.where(fits).mapInPandas(posted, f"cell long, leaf long, id long, v {kind}")
    counts = np.zeros(len(forest.cells), np.int64)
    for r in index.where(fits).select("v").mapInPandas(counted, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():  # one row a leaf: bounded by the forest
        counts[r["leaf"]] = r["n"]
    blocks = -(-np.bincount(forest.cells, weights=counts).astype(np.int64) // BLOCK)
    enough = max(search, needed(forest, units, k, recall) * counts.sum() / len(forest.roots))
    sizes = spark.sparkContext.broadcast((counts, blocks))

    def probing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, blocks = sizes.value
        for batch in filter(len, batches):
            for q, v, u in zip(batch["id"], batch["v"], _unit(batch["v"]), strict=True):
                leaves, total = [], 0
                for leaf in shared.value.search(u):
                    if held[leaf]:
                        leaves.append(leaf)
                        total += int(held[leaf])
                    if total >= enough:
                        break
                by = np.array(leaves, np.int64)
                by = by[np.argsort(shared.value.cells[by], kind="stable")]
                cells, at = np.unique(shared.value.cells[by], return_index=True)
                out = [(c, block, q, v, part) for c, part in zip(cells.tolist(), np.split(by, at[1:]), strict=True) for block in range(int(blocks[c]))]
                yield pd.DataFrame(out, columns=["cell", "block", "query_id", "q", "leaves"])

    def rerank(probes: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(probes) and len(cell):
            cell = cell.sort_values("leaf")
            x, ids, leaf = np.stack(cell["v"]).astype(np.float64), cell["id"].to_numpy(), cell["leaf"].to_numpy()
            norms = np.sqrt((x * x).sum(1))
            unit = x / norms[:, None]
            alone = len(np.unique(ids)) == len(ids)
            for q, v, leaves in zip(probes["query_id"], probes["q"], probes["leaves"], strict=True):
                low, high = np.searchsorted(leaf, leaves), np.searchsorted(leaf, leaves, side="right")
                at = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
                at = at[ids[at] != q]
                if not len(at):
                    continue
                v = np.asarray(v, np.float64)
                rough = unit[at] @ v
                each = rough
                if not alone:  # an id with several vectors counts with its best
                    of = np.unique(ids[at], return_inverse=True)[1]
                    each = np.full(of.max() + 1, -np.inf)
                    np.maximum.at(each, of, rough)
                least = np.partition(each, max(0, len(each) - k))[max(0, len(each) - k)]
                near = at[rough >= least - 1e-9 * np.sqrt((v * v).sum())]  # the product orders them but for its last digits
                score = (x[near] * v).sum(1) / (norms[near] * np.sqrt((v * v).sum()))
                order = np.lexsort((ids[near], -score))
                if not alone:
                    order = order[np.sort(np.unique(ids[near[order]], return_index=True)[1])]
                for j in order[:k]:
                    out.append((q, int(ids[near[j]]), float(score[j])))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    several = [F.lit(int(x)) for c in np.flatnonzero(blocks > 1) for x in (c, blocks[c])]  # bounded by the forest
    block = F.coalesce(F.create_map(*several)[F.col("cell")], F.lit(1)) if several else F.lit(1)
    held = posts.withColumn("block", F.pmod(F.xxhash64("id"), block).cast("long"))
    # Few bytes, much work: as many tasks as partitions are set, however small the queries are.
    lots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    probes = known(queries).dropDuplicates(["id", "v"]).where(fits).repartition(lots, F.xxhash64("id", "v")).mapInPandas(probing, f"cell long, block long, query_id long, q {kind}, leaves array<long>")
    pairs = probes.groupBy("cell", "block").cogroup(held.groupBy("cell", "block")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    found = tables.put(pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "found")
    tables.drop("index")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
