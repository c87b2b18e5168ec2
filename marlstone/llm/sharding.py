"""Sharding by a k-d tree over document metadata, in built-in expressions only.

Equal texts form one point, so they always share a shard. A point's coordinates are metadata of its
smallest member id: that id, the text's length, and ranks of its language and source (hashed to a
number). A node that still has to give k leaves is split along its widest dimension, relative to the
whole table's range, at the weighted quantile floor(k/2)/k of bytes, until every leaf is one shard.
Medians come from distributed histograms of a 62-bit sort key (coordinate, then text hash), refined
until the cut is a sliver of a leaf. The driver sees bin counts only.

Null texts have size 1 (no bytes, plus 1), as empty ones. Repeated rows stay repeated; rows without an id are
placed like others. An empty table gives an empty result. Extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import forget, hot_left_join, shuffle_partitions, small_table, stored

DIMENSIONS = ("d_id", "d_length", "d_lang", "d_source")
_BITS, _BIN_BITS = 62, 10


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def points(docs: DataFrame, id_col: str, text_col: str, meta_cols: tuple[str, str]) -> DataFrame:
    """One row per different text: text_key, weight in bytes, and the coordinates as doubles."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.sha2(text, 256).alias("text_key"),
        (text_bytes(F.col(text_col)) + 1).alias("size"),
        F.struct(F.col(id_col).alias("id"), *[F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"m{i}") for i, c in enumerate(meta_cols)]).alias("first"),
    )
    grouped = rows.groupBy("text_key").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("rows"), F.max("size").alias("length"), F.min("first").alias("first"))
    return grouped.select(
        "text_key",
        "weight",
        "rows",
        F.coalesce(F.col("first.id").cast("double"), F.lit(0.0)).alias("d_id"),
        F.log("length").alias("d_length"),
        F.pmod(F.col("first.m0"), F.lit(1 << 20)).cast("double").alias("d_lang"),
        F.pmod(F.col("first.m1"), F.lit(1 << 20)).cast("double").alias("d_source"),
        F.pmod(F.xxhash64("text_key"), F.lit(1 << 30)).alias("tie"),
    )


def _with_keys(nodes: DataFrame) -> tuple[DataFrame, bool]:
    """Adds ``keys``, a 62-bit sort key for each dimension: 32 bits for the place in the range, 30 of the text's hash."""
    ranges = nodes.agg(*[f(d) for d in DIMENSIONS for f in (F.min, F.max)]).first()
    if ranges[0] is None:
        return nodes, False
    keys = []
    for i, d in enumerate(DIMENSIONS):
        low, high = ranges[2 * i], ranges[2 * i + 1]
        scaled = (F.col(d) - F.lit(low)) / F.lit((high - low) or 1.0) * F.lit(float((1 << 32) - 1))
        keys.append(F.shiftleft(scaled.cast("long"), 30) + F.col("tie"))
    return nodes.withColumn("keys", F.array(*keys)), True


SENT_MOST = 200_000  # rows of a level's cuts that may be broadcast (about 20 MB in memory); more are joined by shuffle


def _per_node(placed: DataFrame, rows: list[tuple], schema: str, how: str = "inner") -> DataFrame:
    """``placed`` with the columns that ``rows`` give for its nodes. There are as many rows as nodes of a level, or leaves."""
    table = small_table(placed.sparkSession, rows, f"node long, {schema}")
    return placed.join(F.broadcast(table) if len(rows) <= SENT_MOST else table, "node", how)


def kd_split(nodes: DataFrame, leaves: int, tolerance: float) -> tuple[list[int], DataFrame]:
    """The numbers of the tree's leaves (root 1, children 2i and 2i + 1), and the points with the ``node`` they come to.

    ``nodes`` is the stored point table with keys; each histogram of a level is one pass of it. Cuts of a level are a small
    table that points are joined to, so trees of any size go down alike.
    """
    placed, done, level, depth = nodes.withColumn("node", F.lit(1).cast("long")), [], [(1, leaves)], 0  # node number, shards it must give
    kept = None
    while level:
        done += [i for i, k in level if k <= 1]
        level = [(i, k) for i, k in level if k > 1]
        if not level:
            break
        spans = [(F.max(F.col("keys")[d]) - F.min(F.col("keys")[d])).alias(f"s{d}") for d in range(len(DIMENSIONS))]
        stats = {r["node"]: r for r in placed.groupBy("node").agg(F.sum("weight").alias("w"), *spans).collect()}  # a row a node
        cuts = []
        for i, k in level:
            s = stats.get(i)
            widest = max(range(len(DIMENSIONS)), key=lambda d: s[f"s{d}"]) if s else 0
            w = s["w"] if s else 0
            cuts.append({"node": i, "k": k, "dim": widest, "goal": w * (k // 2) / k, "low": 0, "bits": _BITS, "below": 0, "slack": tolerance * w / k})
        _refine(placed, cuts)
        right = (F.get(F.col("keys"), F.col("dim")) >= F.col("low")).cast("long")
        placed = _per_node(placed, [(c["node"], c["dim"], c["low"]) for c in cuts], "dim int, low long", "left")
        placed = placed.withColumn("node", F.when(F.col("dim").isNotNull(), 2 * F.col("node") + right).otherwise(F.col("node"))).drop("dim", "low")
        level = [(2 * c["node"] + side, k) for c in cuts for side, k in ((0, c["k"] // 2), (1, c["k"] - c["k"] // 2))]
        depth += 1
        if depth % 5 == 0:  # plans stay short
            before, placed = kept, stored(placed, "kd-placed")
            kept = placed
            if before is not None:
                forget(before)
    return done, placed


def _refine(placed: DataFrame, cuts: list[dict]) -> None:
    """Narrows each cut's bracket [low, low + 2^bits) by histograms of 2^10 bins until its weight is within slack."""
    open_cuts = {c["node"]: c for c in cuts}
    while open_cuts:
        here = _per_node(placed, [(i, c["dim"], c["low"], c["bits"]) for i, c in open_cuts.items()], "dim int, low long, bits int")
        here = here.select("node", "weight", "bits", (F.get(F.col("keys"), F.col("dim")) - F.col("low")).alias("above"))
        here = here.filter((F.col("above") >= 0) & (F.shiftright("above", 1) < F.expr("shiftleft(1L, bits - 1)")))
        bins = here.groupBy("node", F.expr(f"shiftright(above, greatest(bits - {_BIN_BITS}, 0))").alias("bin")).agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"))
        counts: dict[int, list] = {}
        for r in bins.collect():  # 1024 bins a cut at most
            counts.setdefault(r["node"], []).append((r["bin"], r["w"], r["n"]))
        still = {}
        for i, c in open_cuts.items():
            step, at = max(0, c["bits"] - _BIN_BITS), c["below"]
            for b, w, n in sorted(counts.get(i, [])):
                if at + w > c["goal"]:
                    break
                at += w
            else:
                c["low"] += 1 << c["bits"]  # nothing beyond the goal: all of the bracket lies below the cut
                continue
            c["below"], c["low"] = at, c["low"] + (b << step)
            if w <= c["slack"] or n == 1 or step == 0:
                if c["goal"] - at > at + w - c["goal"]:
                    c["low"] += 1 << step
            else:
                c["bits"] = step
                still[i] = c
        open_cuts = still


def shard_documents(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, str] = ("lang", "source"), tolerance: float = 0.002) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard (null: sizes rule, not keys), n_bytes of the shard.

    ``target_bytes`` sets the number of shards from the table's bytes; else ``shards`` does.
    """
    spark = docs.sparkSession
    nodes, some = _with_keys(stored(points(docs, id_col, text_col, meta_cols), "kd-points"))
    nodes = stored(nodes.select("text_key", "weight", "rows", "keys"), "kd-keys") if some else nodes
    if target_bytes is not None:
        total = nodes.agg(F.sum("weight")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    if some:
        leaves, placed = kd_split(nodes, shards, tolerance)
        order = sorted(leaves, key=lambda i: bin(i)[3:].ljust(64, "0"))
        assigned = _per_node(placed, [(i, n) for n, i in enumerate(order)], "shard int").select("text_key", "shard")
    else:
        assigned = nodes.select("text_key", F.lit(0).alias("shard"))

    rows = docs.select(
        id_col,
        (text_bytes(F.col(text_col)) + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_key"),
        F.monotonically_increasing_id().alias("_at"),
    )
    rows = hot_left_join(rows, assigned, ["text_key"], "_at", nodes.select("text_key", F.col("rows").alias("_rows")))
    return _with_slots(rows.withColumn("law", F.lit("bytes")), id_col, shuffle_partitions(spark)).select(
        id_col, "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _with_slots(rows: DataFrame, id_col: str, parts: int) -> DataFrame:
    """Gapless slots in each shard: ranks inside hashed parts of a shard, after the sizes of the parts before."""
    parts = max(8, parts)
    rows = rows.withColumn("part", F.pmod(F.xxhash64(id_col, "text_key"), F.lit(parts)).cast("int"))
    sizes = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # shards x parts rows
    order = Window.partitionBy("shard", "part").orderBy(id_col, "text_key")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked.join(starts, ["shard", "part"]).withColumn("slot", (F.col("start") + F.col("rank") - 1).cast("long"))
