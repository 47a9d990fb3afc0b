"""A Merkle manifest of a dataset, with paths kept as the preimages of the ancestors.

Every parent stores its preimage, the concatenated hashes of its children. A leaf's path is the list of its ancestors'
preimages and its slot in each: cutting the 64 letters of the slot out leaves the siblings, putting another hash there folds
a changed leaf up to the root. Each source is a tree of its leaves; the subroots are the leaves of one more tree.

Paths go downwards: the top node of a tree begins with its source's path, and each level joins its parents, of which every
one has at most 16 children, so no key is hot. Leaves stay in one row a run of 16 until the end; only such rows move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import Tables

ARITY, DIGEST = 16, 64
#: What a leaf hashes, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<slot:int,preimage:string>>"


def hashed(*inputs: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated inputs."""
    return F.sha2(F.concat(*inputs), 256)


def leaf(fields: list[Column]) -> Column:
    """The hash of a row: each field ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    text = [f.cast("string") for f in fields]
    return hashed(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text))


def siblings(path: Column) -> Column:
    """The hashes beside a leaf and its ancestors, level by level, each level left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["preimage"].substr(F.lit(1), p["slot"] * DIGEST), p["preimage"].substr(p["slot"] * DIGEST + DIGEST + 1, F.lit(ARITY * DIGEST)))), "")


def fold(start: Column, path: Column) -> Column:
    """The root that the hash ``start`` gives in the place of the path's leaf."""
    return F.aggregate(path, start, lambda node, p: hashed(p["preimage"].substr(F.lit(1), p["slot"] * DIGEST), node, p["preimage"].substr(p["slot"] * DIGEST + DIGEST + 1, F.lit(ARITY * DIGEST))))


def _placed(rows: DataFrame, order: list[str], tables: Tables, name: str) -> DataFrame:
    """Adds the place ``at`` in the row's tree, from 0, and the tree's size ``n``.

    Ranges of all rows, then the ranges' counts a tree, then places inside a range: a tree of a third of all rows is many
    ranges. The ranges are written, as they must not change when a task runs again.
    """
    rows = tables.put(rows.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()), name)
    inside = Window.partitionBy("tree").orderBy("part")
    starts = rows.groupBy("tree", "part").agg(F.count("*").alias("own"))
    starts = starts.withColumn("start", F.sum("own").over(inside) - F.col("own")).withColumn("n", F.sum("own").over(Window.partitionBy("tree"))).drop("own")
    place = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order)) - 1
    return rows.join(starts, ["tree", "part"]).withColumn("at", F.col("start") + place).drop("part", "start")


def _grown(nodes: DataFrame, tables: Tables, name: str, keep: list[str]) -> list[DataFrame]:
    """The levels above ``nodes`` (tree, at, n, hash), each with the preimages; a tree ends at its level of one node.

    The first level keeps its children's columns ``keep`` as an array, in order.
    """
    levels, kept = [], ["at", "hash", *keep]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1 or not levels:
        up = nodes.where("n > 1" if levels else "true")
        up = up.groupBy("tree", F.floor(F.col("at") / ARITY).alias("up")).agg(F.max("n").alias("below"), F.sort_array(F.collect_list(F.struct(*kept))).alias("children"))
        up = up.withColumn("preimage", F.array_join("children.hash", "")).withColumn("n", F.ceil(F.col("below") / ARITY)).withColumnRenamed("up", "at")
        alone = F.col("below") == 1  # a lone leaf is not hashed again
        up = up.withColumn("hash", F.when(alone, F.col("preimage")).otherwise(F.sha2("preimage", 256))).withColumn("alone", alone)
        nodes = tables.put(up.select("tree", "at", "n", "hash", "preimage", "alone", *([] if levels else ["children"])), f"{name}-{len(levels)}")
        levels.append(nodes)
        most, kept = -(-most // ARITY), ["at", "hash"]
    return levels


def _paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first level with the path of each node; ``above`` (tree, path, ...) is what lies above the trees."""
    lead = [c for c in above.columns if c != "path"]
    down = None
    for level in reversed(levels):
        done = level.where("n = 1").join(above, "tree")
        if down is not None:
            parents = down.select(*lead, F.col("at").alias("up"), F.col("preimage").alias("over"), F.col("path"))
            below = level.where("n > 1").withColumn("up", F.floor(F.col("at") / ARITY)).join(parents, ["tree", "up"])
            step = F.array(F.struct((F.col("at") % ARITY).cast("int").alias("slot"), F.col("over").alias("preimage"))).cast(_PATH)
            done = done.unionByName(below.withColumn("path", F.concat(step, "path")).drop("up", "over"))
        down = done
    return down


def _opened(first: DataFrame, keep: list[str]) -> DataFrame:
    """The children of the first level, each with its own path."""
    one = first.withColumn("child", F.explode("children"))
    step = F.array(F.struct((F.col("child.at") % ARITY).cast("int").alias("slot"), F.col("preimage").alias("preimage"))).cast(_PATH)
    return one.select(*(F.col(c) for c in first.columns if c in ("tree", "subroot")), *(F.col(f"child.{c}").alias(c) for c in keep), F.when(F.col("alone"), F.col("path")).otherwise(F.concat(step, "path")).alias("path"))


def prove(docs: DataFrame, forged: Column | None = None, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", source: str = "source") -> DataFrame:
    """id, leaf, forged, subroot, root and path (slot and preimage of each ancestor, the nearest first) of every row.

    ``forged`` is another leaf hash of the row, null where there is none. Leaves of a source ascend by ``key`` (null first),
    ties by their hash, so repeated rows have one place each and reruns agree. A null source is a tree of its own, before the
    others. Null and empty fields differ in the hash. An empty table gives no rows. Other columns play no part.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    named = F.concat(F.lit("="), F.col(source).cast("string"))
    rows = docs.select(F.coalesce(named, F.lit("")).alias("tree"), F.col(key).alias("id"), leaf([F.col(c) for c in fields]).alias("hash"), (F.lit(None).cast("string") if forged is None else forged).alias("forged"), F.monotonically_increasing_id().alias("row"))
    made = ["leaves", "places", "tops"]
    try:
        leaves = _placed(tables.put(rows, "leaves"), ["id", "hash", "row"], tables, "places")
        levels = _grown(leaves, tables, "level", ["id", "forged"])
        made += [f"level-{k}" for k in range(len(levels))]
        tops = reduce(DataFrame.unionByName, (level.where("n = 1").select(F.lit("").alias("tree"), F.col("tree").alias("source"), "hash") for level in levels))
        crown = _grown(_placed(tops, ["source"], tables, "tops"), tables, "crown", ["source"])
        made += [f"crown-{k}" for k in range(len(crown))]
        root = crown[-1].select("hash").first()
        above = _opened(_paths(crown, spark.createDataFrame([("", [])], f"tree string, path {_PATH}")), ["source", "hash"])
        runs = _paths(levels, above.select(F.col("source").alias("tree"), F.col("hash").alias("subroot"), "path"))
        runs = tables.put(runs.drop("n", "hash"), "runs")
    finally:
        for name in made:
            tables.drop(name)
    return _opened(runs, ["id", "hash", "forged"]).select("id", F.col("hash").alias("leaf"), "forged", "subroot", F.lit(root and root[0]).alias("root"), "path")


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where 5 divides crc32(doc_id) the tampered leaf, whose text has its A-Z lower-cased, is folded with the siblings of the
    original; a null doc_id or text is not tampered with.
    """
    text = F.translate("text", _UPPER, _LOWER)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    forged = F.when(hit, leaf([text if c == "text" else F.col(c) for c in FIELDS]))
    folded = fold(F.coalesce("forged", "leaf"), F.col("path"))
    out = prove(docs, forged).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(levels: int = 6, crowns: int = 4) -> str:
    """DuckDB SQL for ``digest``: enough levels for 16 ** levels rows a source and 16 ** crowns sources."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    row = lambda text: f"sha256({' || '.join(field(text if c == 'text' else c) for c in FIELDS)})"
    # crc32 of the decimal id, byte by byte and bit by bit, reflected polynomial 0xEDB88320
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(d)::BIGINT FOR d IN string_split(doc_id::VARCHAR, '')]), lambda c, b: {bits}))"
    ctes = [
        f"rows AS (SELECT doc_id, source, {row('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {row(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS forged FROM documents)",
        "p0 AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM rows)",
        "f0 AS (SELECT doc_id, source, leaf, pos, coalesce(forged, leaf) AS node, '' AS proof FROM p0)",
    ]

    def climb(p: str, f: str, first: int, last: int, tree: str) -> None:
        for k in range(first, last + 1):
            ctes.append(f"{p}{k} AS (SELECT {tree}, pos // 16 AS pos, string_agg(h, '' ORDER BY pos) AS pre, CASE WHEN max(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h, (max(n) + 15) // 16 AS n, max(n) = 1 AS alone FROM {p}{k - 1} GROUP BY {tree}, pos // 16)")
            cut = "substr(p.pre, 1, 64 * (f.pos % 16)::INT)", "substr(p.pre, 64 * (f.pos % 16)::INT + 65)"
            ctes.append(f"{f}{k} AS (SELECT f.* EXCLUDE (pos, node, proof), f.pos // 16 AS pos, CASE WHEN alone THEN node ELSE sha256({cut[0]} || node || {cut[1]}) END AS node, CASE WHEN alone THEN proof ELSE proof || {cut[0]} || {cut[1]} END AS proof FROM {f}{k - 1} AS f JOIN {p}{k} AS p ON f.{tree} IS NOT DISTINCT FROM p.{tree} AND f.pos // 16 = p.pos)")

    climb("p", "f", 1, levels, "source")
    ctes.append(f"q0 AS (SELECT 0 AS crown, source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM p{levels})")
    ctes.append(f"g0 AS (SELECT doc_id, leaf, 0 AS crown, q0.h AS subroot, q0.pos, node, proof FROM f{levels} JOIN q0 ON f{levels}.source IS NOT DISTINCT FROM q0.source)")
    climb("q", "g", 1, crowns, "crown")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = h AS verified FROM g{crowns}, (SELECT h FROM q{crowns})"


ORACLE = _oracle()
