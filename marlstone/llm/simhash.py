"""SimHash near-duplicates: a grid join of segment popcounts under Manhattan distance, then exact bits.

A document's fingerprint has bit i where over half of its 4-word shingles (repeats included) have bit i in their XXH64 (seed
42). Fingerprints link where at most ``distance`` bits differ; classes are what links connect.

1. Equal fingerprints collapse, so copies are one point.
2. Embedding. A fingerprint becomes the bit counts of its 32 segments of two bits. A differing bit moves one count by at most
   one, so the Manhattan distance of two embeddings is a lower bound of their differing bits.
3. Grid. Of two embeddings at Manhattan distance 4 or less, one half (16 segments) is at 2 or less, and two points at 2 or less
   share a lattice point at 1 or less from either. Every point goes to its own cell and the cells one step away, in each half, and
   points meet by cell.
4. Verifying. In a cell, points are taken in order of their whole bit count (one segment of all: the coarsest bound), and each
   looks only at points without a class within reach of it; the differing bits decide. Of a cell's links a forest goes on, which
   connects what all would.
5. A cell of over ``CELL`` points is dealt to pairs of parts, so no cell fills a task, and no link is lost.

Documents without words (null, empty, white space) have fingerprint zero and link like others. Repeated rows
share a class. A class is named by its smallest id that is not null (null if it has none). An empty table gives no rows, extra columns
are ignored. A very long text is hashed in runs of ``RUN`` shingles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import forget, hot_left_join, stored
from ._hashing import LOWER, byte_class, in_chunks, text_buffers
from .jaccard import classes_of

IS_WORD = byte_class(outside=bytes([0x20, *range(0x09, 0x0E)]))
RUN = 1 << 15  # shingles counted at once
CELL = 20_000  # points of a cell that one task compares
SALTS = 16


def shingle_spans(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of a chunk joined by spaces, start and end of every shingle there, first shingle of every text and the end).

    Words are lower-cased and never cross texts; fewer words than k are one shingle.
    """
    n, texts = len(data), len(offsets) - 1
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = IS_WORD[data]
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])  # where each word begins among the joined ones
    joined = np.full(int(at[-1]), 0x20, np.uint8)
    source = np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)
    joined[np.arange(len(source)) + np.repeat(np.arange(len(size)), size)] = LOWER[data[source]]
    words = np.diff(first)
    count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    word = np.arange(int(begin[-1])) + np.repeat(first[:-1] - begin[:-1], count)
    last = word + np.repeat(np.minimum(words, k), count) - 1
    assert len(count) == texts
    return joined, at[word], at[last] + size[last], begin


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """The fingerprint of every text of a chunk, as a signed 64-bit number."""
    import xxhash

    joined, start, end, begin = shingle_spans(data, offsets, k)
    raw, digest = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
    sums = np.zeros((len(offsets) - 1, 64), np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(begin))
    for a in range(0, len(start), RUN):
        part = slice(a, a + RUN)
        h = np.fromiter((digest(raw[i:j], 42) for i, j in zip(start[part].tolist(), end[part].tolist())), np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edges = np.flatnonzero(np.diff(text[part], prepend=-1))
        sums[text[part][edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
    ones = 2 * sums > np.diff(begin)[:, None]
    return np.packbits(ones.astype(np.uint8), axis=1, bitorder="little").view(np.int64).ravel()


def fingerprint_documents(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, bits: the fingerprint of every document as a long."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for row, data, offsets in in_chunks(*text_buffers(batch.column(1))):
                out[row : row + len(offsets) - 1] = fingerprints_of(data, offsets, k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["id", "bits"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(rows, "id long, bits long")


def _cells(half: Column) -> Column:
    """The cell of a half's 16 segment counts (two bits each, 0 to 2), and those one step away; null for steps that leave the counts."""
    steps = [half]
    for i in range(16):
        count = F.shiftright(half, 2 * i).bitwiseAND(3)
        steps += [F.when(count < 2, half + (1 << 2 * i)), F.when(count > 0, half - (1 << 2 * i))]
    return F.array(*steps)


def forest(points: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): links that connect what all links among different ``points`` (unsigned, of one cell) do.

    From a point, all points without a class that link with it are found at once and go on in turn; those beyond the reach in
    bits set are not looked at.
    """
    total = np.bitwise_count(points).astype(np.int64)
    order = np.argsort(total, kind="stable")
    points, total = points[order], total[order]
    left, weight = np.arange(len(points)), total  # without a class, by bits set
    a, b = [], []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left, weight = left[1:], weight[1:]
        x = queue.pop()
        low, high = np.searchsorted(weight, (total[x] - distance, total[x] + distance + 1))
        near = left[low:high]
        hit = np.bitwise_count(points[near] ^ points[x]) <= distance
        if hit.any():
            found = near[hit]
            a.append(np.full(len(found), points[x], np.uint64))
            b.append(points[found])
            queue.extend(found.tolist())
            left, weight = (np.concatenate([v[:low], v[low:high][~hit], v[high:]]) for v in (left, weight))
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(a), np.concatenate(b)


def fingerprint_links(points: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): links among the different fingerprints ``bits`` of ``points``, enough to connect all that link."""
    if not 0 <= distance <= 5:
        raise ValueError("one grid step covers up to 5 differing bits")
    halves = points.select("bits", F.posexplode(F.array(F.col("bits").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("bits", 32))).alias("half", "value"))
    halves = halves.withColumn("value", F.col("value") - F.shiftright("value", 1).bitwiseAND(0x55555555))  # bits of each segment
    placed = halves.select("bits", "half", F.explode(_cells(F.col("value"))).alias("cell")).filter("cell is not null")
    sizes = placed.groupBy("half", "cell").count().filter("count > 1")
    large = stored(sizes.filter(F.col("count") > CELL).select("half", "cell", F.ceil(F.col("count") / CELL).cast("int").alias("parts")), "large-cells")
    rows = placed.withColumn("p", F.lit(0)).withColumn("q", F.lit(0))
    if large.limit(1).count():
        own = F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(own, i).alias("p"), F.greatest(own, i).alias("q")))
        one = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))
        rows = placed.join(large, ["half", "cell"], "left").select("bits", "half", "cell", F.inline(F.coalesce(pairs, one)))

    def compare(batches):
        import pyarrow as pa

        def work(batch):
            keys, bits = [batch.column(i).to_numpy() for i in range(4)], batch.column(4).to_numpy().view(np.uint64)
            new = np.zeros(len(bits), bool)
            new[0] = True
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            edges = np.append(np.flatnonzero(new), len(bits))
            found, size = [], np.diff(edges)
            # Of two points in a cell, all at once; most cells have no more.
            two = edges[:-1][size == 2]
            two = two[np.bitwise_count(bits[two] ^ bits[two + 1]) <= distance]
            found.append((bits[two], bits[two + 1]))
            found += [forest(bits[edges[i] : edges[i + 1]], distance) for i in np.flatnonzero(size > 2)]
            a, b = (np.concatenate(v).view(np.int64) for v in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held = None  # rows of the last cell, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            same = np.ones(batch.num_rows, bool)
            for i in range(4):
                k = batch.column(i).to_numpy()
                same &= k == k[-1]
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield work(batch.slice(0, cut))
            held = batch.slice(cut)
        if held is not None:
            yield work(held)

    keys = ["half", "cell", "p", "q"]
    met = rows.select(*keys, "bits").repartition(*map(F.col, keys)).sortWithinPartitions(*keys)
    links = met.mapInArrow(compare, "a long, b long")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_classes(docs: DataFrame, distance: int = 4, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (smallest id reachable by links; null if no document of the class has an id)."""
    shapes = stored(fingerprint_documents(docs, k, id_col, text_col), "fingerprints")
    # Copies collapse within salts first: one fingerprint may hold a third of all rows.
    salted = shapes.withColumn("_at", F.monotonically_increasing_id()).withColumn("_salt", F.pmod("_at", F.lit(SALTS)))
    points = stored(salted.groupBy("bits", "_salt").agg(F.min("id").alias("id")).groupBy("bits").agg(F.min("id").alias("id")), "points")
    links = stored(fingerprint_links(points, distance), "links")
    labels = classes_of(links)
    named = points.join(labels.withColumnRenamed("id", "bits"), "bits", "left").withColumn("label", F.coalesce("label", "bits"))
    parts = named.withColumn("_salt", F.pmod(F.xxhash64("bits"), F.lit(SALTS))).groupBy("label", "_salt").agg(F.min("id").alias("id"))
    smallest = stored(parts.groupBy("label").agg(F.min("id").alias("component_id")), "classes")
    classes = stored(named.join(smallest, "label").select("bits", "component_id"), "class-of-points")
    forget(links, labels, points, smallest)
    rows = hot_left_join(salted, classes, ["bits"], "_at")
    return rows.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
