"""Merkle manifest of a dataset: one root over all rows, checkpoints of every few levels, proofs recomputed from them.

A leaf is the SHA-256 (lowercase hex) of a row's fields, each ``-`` for null, else UTF-8 byte count, ``:``, value. Within
a source leaves ascend by id; while several nodes remain, every 16 consecutive ones become the SHA-256 of their digests. The
subroots of the sources, null first and then by bytes, become the root likewise.

1. Placing. Leaves are dealt by ranges of (source, id, leaf) and numbered within a range; the sizes of the ranges before are added,
   so no task holds a source.
2. Checkpoints. ``every`` levels are built at once from aligned blocks of 16^every nodes, and only the blocks of each
   ``every``-th level are stored; the levels between are thrown away.
3. Proofs. From the top down, the missing nodes of each stored block are regenerated from its own nodes, siblings are
   emitted before what the block's top has got from above, and the regenerated nodes are discarded. A path holds, a level, the digests left
   and right of the node; with the leaf they give the root.

All steps are DataFrame functions. Nulls in any field are fields like others; a null id comes first. Rows with one id are ordered
by their leaves, repeated rows are leaves of their own (which of them stands where makes no difference). An empty
text is a value of no bytes, unlike a null. An empty table gives no rows and has no root. Further columns are ignored but for ``carry``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import forget, stored

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*fields: Column | str) -> Column:
    """SHA-256 of the fields of a row; every field tells its length, so no two rows are written alike."""
    texts = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``pos`` from 0 within their group and ``_range``, table of a row for each group and range: start, n of the group).

    Ranges are written with their inner numbers, so a lost executor cannot deal them anew. Equal rows are told apart by where
    they were read, so a key that holds many of them is split too.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    inner = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = stored(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", inner), name)
    ranges = placed.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*group)
    before = F.sum("_size").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumn("n", F.sum("_size").over(whole)).withColumn("_start", F.coalesce(before, F.lit(0)) - F.col("_first"))
    return placed, ranges.drop("_size", "_first")


def _blocks(nodes: DataFrame, size: int, name: str) -> DataFrame:
    """Stored rows (tree, block, n, nodes, carried): aligned blocks of ``size`` nodes of (tree, pos, n, node, carried), in order."""
    one = F.collect_list(F.struct("pos", "node", "carried"))
    rows = nodes.groupBy("tree", F.floor(F.col("pos") / size).alias("block")).agg(F.first("n").alias("n"), F.array_sort(one).alias("v"))
    return stored(rows.select("tree", "block", "n", F.col("v.node").alias("nodes"), F.col("v.carried").alias("carried")), name)


def _digest_of(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes, ""), 256)


def _regenerated(blocks: DataFrame, every: int) -> DataFrame:
    """Adds level0 to level<every> of every block, and height: how many of them its tree still has."""
    height = F.lit(0)
    for j in range(every):
        height = F.when(F.col("n") > ARITY**j, j + 1).otherwise(height)
    rows = blocks.withColumn("height", height).withColumn("level0", F.col("nodes"))
    for j in range(every):
        below = F.col(f"level{j}")
        runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / ARITY).cast("int"))
        rows = rows.withColumn(f"level{j + 1}", F.transform(runs, lambda r: _digest_of(F.slice(below, r * ARITY + 1, F.lit(ARITY)))))  # noqa: B023
    return rows


def _built(nodes: DataFrame, every: int, name: str) -> list[DataFrame]:
    """Stored blocks of each ``every``-th level of the trees of (tree, pos, n, node, carried); a tree ends in a block with n = 1."""
    size, levels = ARITY**every, []
    while True:
        levels.append(_blocks(nodes, size, f"{name}-{len(levels)}"))
        if not levels[-1].filter("n > 1").limit(1).count():
            return levels
        rows = _regenerated(levels[-1].filter("n > 1"), every)
        top = F.coalesce(*(F.when(F.col("height") == j, F.col(f"level{j}")[0]) for j in range(1, every + 1)))
        nodes = rows.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), top.alias("node"), F.lit(None).cast("string").alias("carried"))


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, node): the last node of every tree."""
    ends = [b.filter("n = 1").select("tree", F.col("nodes")[0].alias("node")) for b in levels]
    rows = ends[0]
    for e in ends[1:]:
        rows = rows.unionByName(e)
    return rows


PATH = "array<struct<l: string, r: string>>"


def _paths(levels: list[DataFrame], every: int, above: DataFrame) -> DataFrame:
    """(tree, pos, node, carried, top, path) of the lowest level's nodes, from the top down; ``above`` (tree, top, path) is what the trees' last nodes have got."""
    known = None
    for blocks in reversed(levels):
        ended = blocks.filter("n = 1").join(above, "tree")
        rows = ended if known is None else ended.unionByName(blocks.filter("n > 1").join(known, ["tree", "block"]))
        rows, path, up = _regenerated(rows, every), [], F.col("path")

        def siblings(i, j):
            at, run = F.shiftright(i, 4 * j).bitwiseAND(ARITY - 1), F.shiftright(i, 4 * j + 4) * ARITY  # noqa: B023
            left, right = F.slice(f"level{j}", run + 1, at), F.slice(f"level{j}", run + at + 2, ARITY - 1 - at)
            return F.struct(F.array_join(left, "").alias("l"), F.array_join(right, "").alias("r"))

        def one(i):
            own = F.concat(F.array().cast(PATH), *(F.when(F.col("height") > j, F.array(siblings(i, j))).otherwise(F.array().cast(PATH)) for j in range(every)))
            return F.struct(i.alias("i"), F.element_at("nodes", i + 1).alias("node"), F.element_at("carried", i + 1).alias("carried"), F.concat(own, up).alias("path"))  # noqa: B023

        path = rows.select("tree", "block", "top", F.explode(F.transform(F.sequence(F.lit(0), F.size("nodes") - 1), one)).alias("s"))
        path = path.select("tree", (F.col("block") * ARITY**every + F.col("s.i")).alias("pos"), "s.node", "s.carried", "top", "s.path")
        known = path.select("tree", F.col("pos").alias("block"), "top", "path")
    return path


@dataclass
class Manifest:
    """Checkpoints of the trees of a dataset. ``sources`` (tree, source, subroot); ``root`` has one row, or none for an empty dataset."""

    levels: list[DataFrame]
    upper: list[DataFrame]
    sources: DataFrame
    root: DataFrame
    every: int

    def proofs(self) -> DataFrame:
        """(tree, pos, leaf, carried, subroot, path) of every leaf; path: what stands left and right of its nodes, level by level, up to the root."""
        last = self.root.select(F.lit(0).cast("long").alias("tree"), F.col("root").alias("top"), F.array().cast(PATH).alias("path"))
        above = _paths(self.upper, self.every, last).select(F.col("pos").alias("tree"), F.col("node").alias("top"), "path")
        return _paths(self.levels, self.every, above).withColumnsRenamed({"node": "leaf", "top": "subroot"})


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]), 256))


def siblings_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def build_manifest(docs: DataFrame, every: int = 2, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", carry: Column | None = None) -> Manifest:
    """Leaves, trees and root of ``docs``; ``carry`` is a text that goes along with each leaf (such as an id for its row)."""
    leaves = docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), leaf_digest(*fields).alias("node"), (F.lit(None) if carry is None else carry).cast("string").alias("carried"))
    once = stored(leaves, "leaves")  # ranges are drawn from it, so texts are hashed once
    placed, ranges = _numbered(once, ["source"], ["id", "node"], "placed-leaves")
    ranges = stored(ranges, "leaf-ranges")
    names, spans = _numbered(ranges.groupBy("source").agg(F.first("n").alias("n")), [], ["source"], "sources")
    here = spans.select("_range", "_start")
    trees = names.join(here, "_range").select("source", (F.col("_start") + F.col("_at")).alias("tree"))
    at = ranges.join(trees, ranges["source"].eqNullSafe(trees["source"])).select(ranges["source"].alias("_source"), "_range", "_start", "n", "tree")
    at = stored(at, "tree-ranges")
    # (source, range) is unique there and has the rows of one range of one source here, so no pair is hot.
    nodes = placed.join(at, (placed["_range"] == at["_range"]) & placed["source"].eqNullSafe(at["_source"]))
    nodes = nodes.select("tree", (F.col("_start") + F.col("_at")).alias("pos"), "n", "node", "carried")
    levels = _built(nodes, every, "level")
    sources = stored(trees.join(_tops(levels).withColumnRenamed("node", "subroot"), "tree"), "subroots")
    total = sources.agg(F.count(F.lit(1)).alias("n"))
    subroots = sources.join(F.broadcast(total)).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "n", F.col("subroot").alias("node"), F.lit(None).cast("string").alias("carried"))
    upper = _built(subroots, every, "upper")
    forget(once, placed, ranges, names, at)
    return Manifest(levels, upper, sources, _tops(upper).select(F.col("node").alias("root")), every)


def proof_report(docs: DataFrame, every: int = 2) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; texts of ids whose CRC-32 five divides are lower-cased first.

    A row without an id is not tampered with.
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = leaf_digest(*(lower if f == "text" else f for f in FIELDS))
    carry = F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.when(touched, other))
    manifest = build_manifest(docs, every, carry=carry)
    rows = manifest.proofs().join(F.broadcast(manifest.root))
    parts = F.split("carried", ",")
    rows = rows.withColumn("_id", F.nullif(parts[0], F.lit("-")).cast(docs.schema["doc_id"].dataType)).withColumn("_other", F.get(parts, F.lit(1)))
    rows = rows.select(F.col("_id").alias("doc_id"), "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("_other", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
