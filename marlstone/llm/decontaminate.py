"""Benchmark decontamination by winnowing.

Documents and benchmark items are runs of words. Of every window of w neighbouring k-grams of words the
least hash is kept as a fingerprint, with k + w - 1 = 13 words: whatever 13 words two texts share, they
share a fingerprint in them. Document fingerprints are joined to the benchmark's, and every hit is extended
word by word to both sides; a run of at least 13 equal words is an occurrence of benchmark windows. Items
of fewer words are one window of their own length and are looked up whole.

A benchmark of at most ``block_bytes`` of texts, which is measured first, is one block that every task holds, and
nothing is shuffled. A larger one is joined by shuffle: a bitmap of fixed size, whatever the benchmark, drops most
document fingerprints before they travel; those that the benchmark has bring the words around them, and each window of
these is joined word by word to the benchmark's different windows. Texts with the same windows share one list of items, so a window that many items
and many documents have is expanded once. Both ways give equal rows.

Nulls have no words; repeated rows and rows without an id stay; items without an id are named by nothing; empty tables
(either side) give no hits; extra columns are ignored. Words: A-Z lower-cased, then runs of ASCII letters and digits and of
any non-ASCII characters.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import forget, salted_left_join, stored
from ._hashing import Powers, byte_class, grams, in_chunks, mix, sliding, text_buffers, words_of

IS_WORD = byte_class(outside=bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
K = 5
BITS = 1 << 26  # of the bitmap, 8 MB
BIT_ROWS = 1024
MATCHES = 1 << 20  # pairs of hits that are extended together


def winnow(hashes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Positions of the fingerprints: hashes that are the least of a window of ``width`` neighbours. first: each text's first hash, and the end.

    Windows do not cross texts; all positions of equal least hashes are kept, so the choice depends on the
    window's content alone.
    """
    n = len(hashes)
    keep = np.zeros(n, bool)
    if n < width:
        return np.flatnonzero(keep)
    least = sliding(hashes, width)
    text = np.searchsorted(first, np.arange(n), "right")
    inside = text[: len(least)] == text[width - 1 :]
    least = np.where(inside, least, np.uint64(0))
    reach = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero(sliding(reach, width, least=False) == hashes)


class Block:
    """Benchmark items of one block, as arrays that executors search."""

    def __init__(self, ids: list, texts: list[str], window: int):
        powers, self.window = Powers(), window
        raw = [(t or "").encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        self.words, self.first = words_of(np.frombuffer(b"".join(raw), np.uint8), offsets, IS_WORD, powers)
        self.ids = [str(i) for i in ids]
        self.item = np.repeat(np.arange(len(raw)), np.diff(self.first))
        k = min(K, window)
        hashes = grams(self.words, k)
        at = winnow(hashes, self.first, window - k + 1)
        at = at[self.item[at] == self.item[at + k - 1]]
        order = np.argsort(hashes[at], kind="stable")
        self.hashes, self.at = hashes[at][order], at[order]
        counts = np.diff(self.first)
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, window):
            items = np.flatnonzero(counts == n)
            if len(items):
                h = np.array([grams(self.words[self.first[i] : self.first[i] + n], n)[0] for i in items])
                order = np.argsort(h, kind="stable")
                self.short[n] = (h[order], items[order])

    @staticmethod
    def _matches(sorted_hashes: np.ndarray, hashes: np.ndarray):
        """Pairs (index in hashes, index in sorted_hashes) of equal values, some at a time."""
        low, high = np.searchsorted(sorted_hashes, hashes, "left"), np.searchsorted(sorted_hashes, hashes, "right")
        some = np.flatnonzero(high > low)
        ends = np.cumsum((high - low)[some])
        at = 0
        while at < len(some):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MATCHES, "right")))
            part = some[at:to]
            n = (high - low)[part]
            yield np.repeat(part, n), np.repeat(low[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = to

    def hits(self, words: np.ndarray, first: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, end, item) of runs of document words that are occurrences of this block's windows."""
        window, k = self.window, min(K, self.window)
        found = [np.zeros((3, 0), np.int64)]
        if len(self.hashes) and len(words) >= window:
            hashes = grams(words, k)
            at = winnow(hashes, first, window - k + 1)
            at = at[text[at] == text[at + k - 1]]
            for here, there in self._matches(self.hashes, hashes[at]):
                d, b = at[here], self.at[there]
                left, right = np.zeros(len(d), np.int64), np.zeros(len(d), np.int64)
                for count, sides in ((left, range(-1, -window, -1)), (right, range(0, window))):
                    alive = np.arange(len(d))
                    for step in sides:
                        i, j = d[alive] + step, b[alive] + step
                        ok = (i >= 0) & (i < len(words)) & (j >= 0) & (j < len(self.words))
                        alive, i, j = alive[ok], i[ok], j[ok]
                        ok = (words[i] == self.words[j]) & (text[i] == text[d[alive]]) & (self.item[j] == self.item[b[alive]])
                        alive = alive[ok]
                        count[alive] += 1
                long = left + right >= window
                found.append(np.unique(np.stack([(d - left)[long], (d + right)[long], self.item[b[long]]]), axis=1))
        for n, (hashes, items) in self.short.items():
            for here, there in self._matches(hashes, grams(words, n)):
                ok = text[here] == text[here + n - 1]
                found.append(np.stack([here[ok], here[ok] + n, items[there[ok]]]))
        return tuple(np.concatenate(found, axis=1))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def one_block(items: DataFrame, window: int, block_bytes: int) -> Block | None:
    """All items, if their texts have at most ``block_bytes``."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > block_bytes:
        return None
    rows = items.toPandas()
    return Block(rows["item"].tolist(), rows["text"].tolist(), window)


def _scan(sent, powers: Powers, column, with_spans: bool) -> tuple[np.ndarray, np.ndarray, list[list], list[list]]:
    """(words, words hit, items, runs of hit words) of every text of an Arrow column."""
    rows = len(column)
    n_words, n_hit, items = np.zeros(rows, np.int64), np.zeros(rows, np.int64), [[] for _ in range(rows)]
    spans: list[list] = [[] for _ in range(rows)]
    for row, data, offsets in in_chunks(*text_buffers(column)):
        words, first = words_of(data, offsets, IS_WORD, powers)
        counts = np.diff(first)
        n_words[row : row + len(counts)] = counts
        text = np.repeat(np.arange(len(counts)), counts)
        change = np.zeros(len(words) + 1, np.int64)
        touched: dict[int, set] = {}
        begin, end, item = sent.value.hits(words, first, text)
        np.add.at(change, begin, 1)
        np.add.at(change, end, -1)
        for t, i in set(zip(text[begin].tolist(), item.tolist())):
            touched.setdefault(t, set()).add(sent.value.ids[i])
        hit = np.cumsum(change[:-1]) > 0
        for t, found in touched.items():
            own = hit[first[t] : first[t + 1]]
            n_hit[row + t] = int(own.sum())
            items[row + t] = sorted(found)
            if with_spans:
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                spans[row + t] = [{"at": int(a), "n": int(b - a)} for a, b in zip(edges[::2], edges[1::2])]
    return n_words, n_hit, items, spans


# ---------------------------------------------------------------------------- by shuffle


def _runs(words: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Arrow column: the words (eight bytes each) of every run words[begin:end]."""
    import pyarrow as pa

    n = end - begin
    ends = np.cumsum(n)
    own = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - n), n)
    offsets = np.concatenate([np.zeros(1, np.int64), 8 * ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(words[own].tobytes())])


def _narrow(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).view(np.int64)


def _benchmark_rows(items: DataFrame, window: int, bits: int) -> DataFrame:
    """(kind, hash, words, item): every window (kind: its number of words), and every fingerprint (kind 0, neither words nor item)."""

    def rows(batches):
        import pyarrow as pa

        powers, k = Powers(), min(K, window)
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), object)
            for row, data, offsets in in_chunks(*text_buffers(batch.column(1))):
                words, first = words_of(data, offsets, IS_WORD, powers)
                counts = np.diff(first)
                text = np.repeat(np.arange(len(counts)), counts)
                for n in range(1, window + 1):
                    h = grams(words, n)
                    at = np.flatnonzero(text[: len(h)] == text[n - 1 :]) if len(h) else np.zeros(0, np.int64)
                    at = at if n == window else at[counts[text[at]] == n]
                    if len(at):
                        columns = [pa.array(np.full(len(at), n, np.int32)), pa.array(_narrow(h[at], bits)), _runs(words, at, at + n), pa.array(ids[row + text[at]].tolist(), pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, names=names)
                h = grams(words, k)
                at = winnow(h, first, window - k + 1)
                at = at[text[at] == text[at + k - 1]]
                columns = [pa.array(np.zeros(len(at), np.int32)), pa.array(_narrow(h[at], bits)), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["kind", "hash", "words", "item"]
    return items.mapInArrow(rows, "kind int, hash long, words binary, item string").distinct()


def _places(kind, hashes: np.ndarray) -> np.ndarray:
    """Bits of probes in the bitmap."""
    return (mix(hashes + np.uint64(1) + np.asarray(kind).astype(np.uint64)) >> np.uint64(20)).astype(np.int64) & (BITS - 1)


def _bitmap(probes: DataFrame) -> np.ndarray:
    """BITS bits, as bytes, of which those of the probes (kind, hash) are set; put together in BIT_ROWS rows."""
    width = BITS // 8 // BIT_ROWS

    def some(batches):
        import pyarrow as pa

        bits = np.zeros(BITS // 8, np.uint8)
        for batch in batches:
            at = _places(batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64))
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        rows = bits.reshape(BIT_ROWS, width)
        on = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array([rows[i].tobytes() for i in on], pa.binary())], names=["row", "bits"])

    def join(batches):
        import pyarrow as pa

        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[row] = found.get(row, 0) | np.frombuffer(bits, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], names=["row", "bits"])

    out = np.zeros((BIT_ROWS, width), np.uint8)
    rows = probes.mapInArrow(some, "row int, bits binary").repartition(F.col("row")).mapInArrow(join, "row int, bits binary")
    for r in rows.collect():  # BIT_ROWS rows
        out[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def _hit_texts(texts: DataFrame, items: DataFrame, window: int, share: int, bits: int = 64) -> DataFrame:
    """(h1, h2, n_hit, items, spans, contaminated) of the different texts (text) with occurring windows.

    Hashes of ``bits`` bits choose which places are looked at; whether a window occurs there is decided word by word.
    """
    bench = stored(_benchmark_rows(items, window, bits), "benchmark-rows")
    # Probes: fingerprints of whole windows, and the short items themselves.
    probes = stored(bench.filter(F.col("kind") < window).select("kind", "hash").distinct(), "benchmark-probes")
    # Different windows by number.
    known = stored(bench.filter("kind > 0").select("words").distinct().select("words", F.monotonically_increasing_id().alias("window")), "benchmark-windows")
    kinds = sorted(r[0] for r in probes.filter("kind > 0").select("kind").distinct().collect())  # fewer than ``window``
    sent = texts.sparkSession.sparkContext.broadcast(_bitmap(probes))

    def probe(batches):
        import pyarrow as pa

        powers, k, on = Powers(), min(K, window), sent.value
        names = ["kind", "hash", "h1", "h2", "n_words", "at", "words"]
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy() for i in (1, 2))
            for row, data, offsets in in_chunks(*text_buffers(batch.column(0))):
                words, first = words_of(data, offsets, IS_WORD, powers)
                counts = np.diff(first)
                text = np.repeat(np.arange(len(counts)), counts)
                for kind in [0, *kinds]:
                    n = kind or k
                    h = grams(words, n)
                    at = np.flatnonzero(text[: len(h)] == text[n - 1 :]) if kind and len(h) else winnow(h, first, window - k + 1) if len(h) else np.zeros(0, np.int64)
                    at = at[text[at] == text[at + n - 1]]
                    place = _places(kind, _narrow(h[at], bits).view(np.uint64))
                    at = at[on[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0]
                    if not len(at):
                        continue
                    begin, end = at, at + n
                    if not kind:  # all windows that hold the fingerprint, as one run of words
                        begin, end = np.maximum(first[text[at]], at + k - window), np.minimum(first[text[at] + 1], at + window)
                    t = row + text[at]
                    columns = [np.full(len(at), kind, np.int32), _narrow(h[at], bits), h1[t], h2[t], counts[text[at]], (begin - first[text[at]]).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), _runs(words, begin, end)], names=names)

    schema = "kind int, hash long, h1 long, h2 long, n_words long, at int, words binary"
    found = texts.select("text", *_text_key(F.col("text"))).mapInArrow(probe, schema).join(probes, ["kind", "hash"], "left_semi")
    key = ["h1", "h2", "n_words"]
    found = found.select(*key, "at", "words", F.when(F.col("kind") > 0, F.col("kind")).otherwise(window).alias("n"))
    found = found.withColumn("more", (F.octet_length("words") / 8).cast("int") - F.col("n")).filter("more >= 0")
    found = found.select(*key, "n", "at", "words", F.explode(F.sequence(F.lit(0), "more")).alias("i"))
    found = found.select(*key, "n", (F.col("at") + F.col("i")).alias("at"), F.expr("substring(words, 8 * i + 1, 8 * n)").alias("words"))
    hits = found.distinct().join(known, "words").drop("words")
    # A text's hits lie in one row, as the text does.
    row = hits.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("windows"), F.sort_array(F.collect_set("window")).alias("combo"))
    span = "array<struct<at:int,n:int>>"
    merged = F.aggregate(
        "windows",
        F.array().cast(span),
        lambda acc, w: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["at"] + F.try_element_at(acc, F.lit(-1))["n"] >= w["at"]),
            F.concat(
                F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(acc, F.lit(-1))["at"].alias("at"), F.greatest(F.try_element_at(acc, F.lit(-1))["n"], w["at"] + w["n"] - F.try_element_at(acc, F.lit(-1))["at"]).alias("n"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(w["at"].alias("at"), w["n"].alias("n"))))).cast(span),
    )
    row = row.withColumn("spans", merged).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n"]))
    row = stored(row.withColumn("c1", F.xxhash64("combo")).withColumn("c2", F.xxhash64(F.lit("second"), "combo")), "hit-texts")
    # Items of each different set of windows; a set's items are one value of the result.
    combos = row.groupBy("c1", "c2").agg(F.first("combo").alias("combo")).select("c1", "c2", F.explode("combo").alias("window"))
    named = bench.filter("kind > 0").select("words", "item").join(known, "words").select("window", "item")
    lists = combos.join(named, "window").groupBy("c1", "c2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = stored(row.join(lists, ["c1", "c2"]).select("h1", "h2", "n_hit", "items", "spans", (share * F.col("n_hit") >= F.col("n_words")).alias("contaminated")), "hits")
    forget(bench, probes, known, row)
    sent.unpersist()
    return out


def _counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h1, h2, n_words."""

    def count(batches):
        import pyarrow as pa

        powers = Powers()
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for row, data, offsets in in_chunks(*text_buffers(batch.column(3))):
                n[row : row + len(offsets) - 1] = np.diff(words_of(data, offsets, IS_WORD, powers)[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(n)], names=[id_col, "h1", "h2", "n_words"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, *_text_key(text), text.alias("text")).mapInArrow(count, f"{id_col} {kind}, h1 long, h2 long, n_words long")


# ---------------------------------------------------------------------------- the operator


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", benchmark_col: str = "text", with_spans: bool = False) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words); and, if asked for, items and spans (words)."""
    items = _items(benchmark, item_col, benchmark_col)
    block = one_block(items, window, block_bytes)
    if block is None:
        texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
        hits = _hit_texts(texts, items, window, share)
        rows = salted_left_join(_counted(docs, id_col, text_col), hits, ["h1", "h2"], F.monotonically_increasing_id())
        found = F.coalesce("items", F.array().cast("array<string>"))
        extra = [found.alias("items"), F.coalesce("spans", F.array().cast("array<struct<at:int,n:int>>")).alias("spans")] if with_spans else []
        return rows.select(
            id_col,
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(found).cast("long").alias("n_items"),
            F.sha2(F.array_join(found, ","), 256).alias("items_sha256"),
            F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
            *extra,
        )
    sent = docs.sparkSession.sparkContext.broadcast(block)
    extra = ", items array<string>, spans array<struct<at:int,n:int>>" if with_spans else ""

    def scan(batches):
        import hashlib

        import pyarrow as pa

        powers = Powers()
        for batch in batches:
            n_words, n_hit, items, spans = _scan(sent, powers, batch.column(1), with_spans)
            columns = [
                batch.column(0),
                pa.array(n_words),
                pa.array(n_hit),
                pa.array([len(i) for i in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
                pa.array((n_hit > 0) & (share * n_hit >= n_words)),
            ]
            names = [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
            if with_spans:
                columns += [pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())])))]
                names += ["items", "spans"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(scan, f"{id_col} {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean{extra}")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_bytes: int = 8 << 20, text_col: str = "text", item_col: str = "item_id", benchmark_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    items = _items(benchmark, item_col, benchmark_col)
    block = one_block(items, window, block_bytes)
    if block is None:
        text = F.coalesce(F.col(text_col), F.lit(""))
        hits = _hit_texts(docs.select(text.alias("text")).distinct(), items, window, share).filter("contaminated").select("h1", "h2", F.lit(True).alias("_gone"))
        keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_text_key(text))
        return salted_left_join(keyed, hits, ["h1", "h2"], F.monotonically_increasing_id()).filter("_gone is null").select("row.*")
    sent, at = docs.sparkSession.sparkContext.broadcast(block), docs.columns.index(text_col)

    def keep(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        powers = Powers()
        for batch in batches:
            n_words, n_hit, _, _ = _scan(sent, powers, pc.fill_null(batch.column(at), ""), False)
            yield batch.filter(pa.array((n_hit == 0) | (share * n_hit < n_words)))

    return docs.mapInArrow(keep, docs.schema)
