"""Removal of byte strings that occur more than once, by suffix arrays built in two stages.

A byte is removed if a string of ``length`` (200) bytes over it also starts anywhere else. Three steps:

1. Dealing. Every window of 200 bytes is keyed by its least hash of 64 neighbouring bytes, a function of the
   window alone, so equal windows share a key. Neighbouring windows with one key form a segment; a
   segment's context is the bytes its windows cover. Keys that occur once cannot repeat and end here
   (unless the anchor itself recurs within the segment).
   Where all contexts of a key have one 64-bit hash, or the key is frequent, digests of their bytes (128 bits of
   BLAKE2b) are compared first: equal contexts repeat in every window, and of different ones one each goes on.
2. Sorting. The other contexts meet by key and are concatenated to blocks, whose suffix arrays are built
   in two stages: suffixes smaller than their successors are sorted directly, the others are induced by
   scanning the buckets of first bytes in order. Windows that share 200 bytes with a neighbour
   in the array (adjacent common prefixes) repeat. Keys with very many different contexts are split by whole
   windows first, which meet by hash and digest of their bytes, so no key fills a task.
3. Cutting. The repeated windows of a document meet its text and their bytes are cut.

Strings are judged on the input, and never cross documents. Nulls are empty texts; shorter texts
than ``length`` are kept whole; an empty table gives no rows. Extra columns are ignored. Repeated rows are documents of
their own, and so are rows without an id: where rows are equal in id and text, every string of theirs repeats, so one of them
is compared with the others and all of them go. Rows are told apart by 128 bits of hashes of id, length and text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import hot_left_join, lean, stored
from ._hashing import Powers, Rolling, in_chunks, sliding, text_buffers

ANCHOR = 64  # bytes of an anchor
RUN = 256  # windows of a segment at most
HOT = 8_000  # contexts (of 455 bytes at most, so a key adds 3.6 MB to a block) of a key that are sorted together
SENT_MOST = 200_000  # segments asked for that may be broadcast (about 20 MB)
BLOCK = 1 << 19  # bytes of a block whose suffixes are sorted together: with the last key at most 4.1 MB, of which sorting takes about 60 times as much
SORTED, WHOLE, WINDOWS = 0, 1, 2  # how a key's segments are compared


# ---------------------------------------------------------------------------- segments


def segments(data: np.ndarray, offsets: np.ndarray, length: int, powers: Powers):
    """(key, context hash, text number, start in the text, windows, whether two windows may be equal) of every segment of a chunk."""
    rolling = Rolling(data, powers)
    anchor = min(ANCHOR, length)
    width = length - anchor + 1
    hashes = rolling.all_of(anchor)
    least = sliding(hashes, width)
    if not len(least):
        return [np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool)]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    fits = np.arange(len(least)) + length <= offsets[text + 1]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (fits[1:] != fits[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(least)))
    begin, count = begin[fits[begin]], count[fits[begin]]
    pieces = -(-count // RUN)
    if (pieces > 1).any():  # long runs of one key: equal windows still meet, as they share it
        first = np.repeat(np.cumsum(pieces) - pieces, pieces)
        step = (np.arange(pieces.sum()) - first) * RUN
        begin, count = np.repeat(begin, pieces) + step, np.minimum(np.repeat(count, pieces) - step, RUN)
    context = rolling.spans(begin, begin + count + length - 1)
    # Two equal windows of one segment hold the key's anchor at two places.
    margin = np.zeros(width - 1, np.uint64)
    anchors = np.flatnonzero(sliding(np.concatenate([margin, least, margin]), width, least=False) == hashes)
    low, high = np.searchsorted(anchors, begin), np.searchsorted(anchors, begin + count + width - 1)
    some = high - low
    which = np.repeat(np.arange(len(begin)), some)
    at = np.repeat(low, some) + np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
    inner = np.bincount(which[hashes[anchors[at]] == least[begin][which]], minlength=len(begin)) > 1
    return least[begin].view(np.int64), context.view(np.int64), text[begin], begin - offsets[text[begin]], count, inner


def _segment_rows(docs: DataFrame, length: int) -> DataFrame:
    @lean
    def rows(batches):
        import pyarrow as pa

        powers = Powers()
        for batch in batches:
            k, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, data, offsets in in_chunks(*text_buffers(batch.column(2))):
                key, context, text, at, n, inner = segments(data, offsets, length, powers)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (key, context, k[first + text], th[first + text], at.astype(np.int32), n.astype(np.int32), inner)],
                    names=["key", "context", "k", "th", "at", "n", "inner"],
                )

    return docs.mapInArrow(rows, "key long, context long, k long, th long, at int, n int, inner boolean")


# ---------------------------------------------------------------------------- suffix arrays


def _by_bytes(text: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The order of the strings text[begin[i]:end[i]], eight bytes at a time; only strings that are still equal are looked at again."""
    words = np.ndarray((len(text) + 1,), ">u8", text + b"\0" * 8, 0, (1,))  # eight bytes from every position
    order = np.arange(len(begin))
    alive, group = order.copy(), np.zeros(len(begin), np.int64)  # places in ``order`` that are undecided, and which of them are equal so far
    at = 0
    while len(alive):
        own = order[alive]
        rest = np.clip(end[own] - begin[own] - at, 0, 8)
        word = words[np.minimum(begin[own] + at, len(text))].astype(np.uint64)
        word &= np.where(rest > 0, np.uint64(0xFFFFFFFFFFFFFFFF) << (np.uint64(64) - 8 * np.maximum(rest, 1).astype(np.uint64)), np.uint64(0))
        # Bytes beyond an end count as zeros, and of strings that are then equal the one that ends is the smaller.
        sort = np.lexsort((rest, word, group))
        order[alive] = own[sort]
        word, rest, group = word[sort], rest[sort], group[sort]
        same = (word[1:] == word[:-1]) & (rest[1:] == rest[:-1]) & (group[1:] == group[:-1])
        begins = np.concatenate([[True], ~same])
        group = np.cumsum(begins)
        tied = (np.concatenate([[False], same]) | np.concatenate([same, [False]])) & (rest == 8)
        alive, group = alive[tied], group[tied]
        at += 8
    return order


def suffix_order(text: bytes, ends: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted positions in the order of their suffixes' first ``depth`` bytes, in two stages.

    ``ends[i]`` is where the string that holds position i ends; a suffix ends there, and the end sorts
    before every byte.
    """
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    places = np.arange(n, dtype=np.int32)
    last = ends == places + 1
    following = np.append(t[1:], 0).astype(np.int16)
    rise = np.sign(following - t)
    rise[last] = -1  # the end is smaller
    # Equal neighbours share their type with the next position that differs.
    at = np.where(rise != 0, places, np.int32(n))
    at = np.minimum.accumulate(at[::-1])[::-1]
    smaller = rise[at] > 0  # smaller than its successor
    need = np.zeros(n, bool)
    need[wanted] = True
    # Larger ones are induced from their successors: add those up to the next smaller one.
    stop = np.where(smaller | last, places, np.int32(n))
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    reach = np.zeros(n + 1, np.int32)
    np.add.at(reach, wanted, 1)
    np.add.at(reach, stop[wanted] + 1, -1)
    need |= np.cumsum(reach[:n]) > 0

    # Stage one: direct.
    direct = places[need & smaller]
    direct = direct[_by_bytes(text, direct, np.minimum(direct + depth, ends[direct]))]
    by_first = np.searchsorted(t[direct], np.arange(257))

    # Stage two: buckets of first bytes in order; whoever precedes a sorted suffix and is larger goes next into its own bucket.
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induce = need & ~smaller
    for i in places[induce & last]:
        induced[t[i]].append(np.array([i]))
    starts = np.zeros(n + 1, bool)
    starts[0], starts[1:] = True, last

    def deal(found: np.ndarray, bucket: int) -> np.ndarray:
        """Sends the larger predecessors of ``found`` to their buckets; returns those of this very bucket."""
        before = found[~starts[found]] - 1
        before = before[induce[before]]
        first = t[before]
        same = before[first == bucket]
        other = before[first != bucket]
        if len(other):
            first = t[other]
            order = np.argsort(first, kind="stable")
            cuts = np.flatnonzero(np.diff(first[order])) + 1
            for part in np.split(other[order], cuts):
                induced[t[part[0]]].append(part)
        return same

    order = []
    for bucket in range(256):
        front = np.concatenate(induced[bucket]) if induced[bucket] else np.zeros(0, np.int64)
        induced[bucket] = []
        while len(front):
            order.append(front)
            front = deal(front, bucket)
        front = direct[by_first[bucket] : by_first[bucket + 1]]
        if len(front):
            order.append(front)
            deal(front, bucket)
    found = np.concatenate(order) if order else np.zeros(0, np.int64)
    asked = np.zeros(n, bool)
    asked[wanted] = True
    return found[asked[found]]


def common_prefixes(text: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """Length, up to ``depth``, of the common prefix of each suffix and the one before it (the first: 0); all hold ``depth`` bytes."""
    prefix = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return prefix
    padded = text + b"\0" * 8
    words = np.ndarray((len(text) + 1,), "<u8", padded, 0, (1,))  # eight bytes from every position
    alive = np.arange(1, len(order))
    for at in range(0, depth, 8):
        a, b = words[order[alive] + at], words[order[alive - 1] + at]
        differ = a ^ b
        if depth - at < 8:
            differ &= np.uint64((1 << 8 * (depth - at)) - 1)
        same = differ == 0
        gone = alive[~same]
        d = differ[~same]
        low = d & (~d + np.uint64(1))
        prefix[gone] = at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        alive = alive[same]
    prefix[alive] = depth
    return prefix


def repeated_windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, which of its windows of ``length`` bytes occur at another place in these contexts."""
    text = b"".join(contexts)
    sizes = np.array([len(c) for c in contexts])
    ends = np.repeat(np.cumsum(sizes).astype(np.int32), sizes)  # a block is far below 2^31 bytes
    wanted = np.flatnonzero(np.arange(len(text), dtype=np.int32) + length <= ends).astype(np.int32)
    order = suffix_order(text, ends, wanted, length)
    prefix = common_prefixes(text, order, length)
    twice = np.zeros(len(text), bool)
    hit = np.flatnonzero(prefix >= length)
    twice[order[hit]] = True
    twice[order[hit - 1]] = True
    return [twice[e - s : max(e - s, e - length + 1)] for s, e in zip(sizes.tolist(), np.cumsum(sizes).tolist())]


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - edges[::2]


SPANS = "k long, th long, at int, n int"


def _sorted_blocks(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows among contexts with one key; rows come sorted by key."""

    @lean
    def spans(batches):
        import pyarrow as pa

        held: list[tuple] = []
        size = 0

        def flush():
            out: tuple[list, ...] = ([], [], [], [])
            # Equal contexts are sorted once; where there are several, all of their windows repeat.
            times: dict[bytes, int] = {}
            for h in held:
                times[h[4]] = times.get(h[4], 0) + 1
            found = {c: np.ones(len(m), bool) if times[c] > 1 else m for c, m in zip(times, repeated_windows(list(times), length))}
            for _, k, th, at, context in held:
                marks = found[context]
                for start, n in zip(*map(np.ndarray.tolist, _runs(marks))):
                    for column, value in zip(out, (k, th, at + start, n)):
                        column.append(value)
            held.clear()
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["k", "th", "at", "n"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size >= BLOCK and held and row[0] != held[-1][0]:
                    yield flush()
                    size = 0
                held.append(row)
                size += len(row[4])
        if held:
            yield flush()

    dealt = contexts.repartition(F.col("key")).sortWithinPartitions("key")
    return dealt.mapInArrow(spans, SPANS)


# ---------------------------------------------------------------------------- the operator


def _keys(id_col: str, text_col: str) -> list[Column]:
    """k and th: 64 bits each of id and text, and of length and text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(F.col(id_col).cast("long"), text).alias("k"), F.xxhash64(F.octet_length(text), text).alias("th")]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*_keys(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _repeated_rows(texts: DataFrame, length: int) -> DataFrame:
    """(k, th, size, _rows) of rows with equal id and text, where the text has ``length`` bytes or more."""
    size = F.octet_length("text")
    rows = texts.filter(size >= length).groupBy("k", "th").agg(F.count(F.lit(1)).alias("_rows"), F.min(size).alias("size"))
    return stored(rows.filter("_rows > 1"), "repeated-rows")


def _fetched(texts: DataFrame, asked: DataFrame, length: int, few: bool = False) -> DataFrame:
    """(key, k, th, at, n, digest, context) of the segments asked for.

    As ``kind`` says: a digest of the context, or the context, or a row for each window, with its hash as the key and a digest
    of its bytes. ``few`` segments are sent to the texts.
    """
    lists = asked.groupBy("k", "th").agg(F.collect_set(F.struct("at", "n", "key", "kind")).alias("asked"))  # repeated rows ask once

    @lean
    def fetch(batches):
        import hashlib

        import pyarrow as pa

        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        names = ["key", "k", "th", "at", "n", "digest", "context"]
        digest = lambda raw: hashlib.blake2b(raw, digest_size=16).digest()
        powers = Powers()
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            size, out = 0, tuple([] for _ in types)
            for i, (k, th, wants) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                if not wants:
                    continue
                own = data[offsets[i] : offsets[i + 1]]
                raw = own.tobytes()
                windows = Rolling(own, powers).all_of(length).view(np.int64) if any(w["kind"] == WINDOWS for w in wants) else None
                for w in wants:
                    at, n = w["at"], w["n"]
                    if w["kind"] == WINDOWS:
                        rows = [(int(windows[j]), k, th, j, 1, digest(raw[j : j + length]), None) for j in range(at, at + n)]
                    elif w["kind"] == WHOLE:
                        rows = [(w["key"], k, th, at, n, digest(raw[at : at + n + length - 1]), None)]
                    else:
                        rows = [(w["key"], k, th, at, n, None, raw[at : at + n + length - 1])]
                    size += sum(len(r[6] or b"") + 64 for r in rows)
                    for column, values in zip(out, zip(*rows)):
                        column.extend(values)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
                    size, out = 0, tuple([] for _ in types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return texts.join(F.broadcast(lists) if few else lists, ["k", "th"]).mapInArrow(fetch, "key long, k long, th long, at int, n int, digest binary, context binary")


def repeated_spans(texts: DataFrame, repeated: DataFrame, length: int = 200) -> DataFrame:
    """(k, th, spans) of rows (k, th, text): arrays of (at, n), n windows from byte at on that repeat. ``repeated`` has the keys of several rows."""
    some = bool(repeated.limit(1).count())
    if some:  # one of them stands for all
        stands = repeated.select("k", "th")
        first = texts.join(stands, ["k", "th"], "left_semi").groupBy("k", "th").agg(F.first("text").alias("text"))
        texts = texts.join(stands, ["k", "th"], "left_anti").unionByName(first)
    segs = _segment_rows(texts, length)
    keys = segs.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("context").alias("low"), F.max("context").alias("high"), F.max("inner").alias("inner"))
    # A table of its own, so that both sides of the join are dealt anew and Spark can split a hot key's rows.
    kind = F.when(F.expr("rows > 1 and low = high") | (F.col("rows") > HOT), WHOLE).otherwise(SORTED)
    keys = stored(keys.filter("rows > 1 or inner").select("key", kind.alias("kind")), "keys")
    fetched = stored(_fetched(texts, segs.join(keys, "key").select("k", "th", "at", "n", "key", "kind"), length), "segments")
    spans = _sorted_blocks(fetched.filter("context is not null").select("key", "k", "th", "at", "context"), length)

    # Contexts that are equal in 128 bits of BLAKE2b beside their key repeat in every window.
    alike = fetched.filter("digest is not null")
    contexts = alike.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("k", "th", "at", "n")).alias("first"))
    contexts = stored(contexts, "contexts")
    spans = spans.unionByName(alike.join(contexts.filter("rows > 1").select("key", "digest"), ["key", "digest"]).select("k", "th", "at", "n"))
    # One of each different context of a key is compared with the others of that key.
    several = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("different")).filter("different > 1")
    kind = F.when(F.col("different") > HOT, WINDOWS).otherwise(SORTED)
    again = stored(contexts.join(several.select("key", kind.alias("kind")), "key").select("first.*", "key", "kind"), "different-contexts")
    n = again.count()
    if n:
        more = stored(_fetched(texts, again, length, n <= SENT_MOST), "segments")
        spans = spans.unionByName(_sorted_blocks(more.filter("context is not null").select("key", "k", "th", "at", "context"), length))
        windows = more.filter("digest is not null")
        twice = windows.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("key", "digest")
        spans = spans.unionByName(windows.join(twice, ["key", "digest"]).select("k", "th", "at", "n"))
    if some:
        spans = spans.join(stands, ["k", "th"], "left_anti").unionByName(repeated.select("k", "th", F.lit(0).alias("at"), (F.col("size") - length + 1).cast("int").alias("n")))
    return spans.groupBy("k", "th").agg(F.collect_set(F.struct("at", "n")).alias("spans"))


def _with_spans(rows: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """Adds k, th, spans to every row; many equal rows are dealt over tasks."""
    texts = _texts(rows, id_col, text_col)
    repeated = _repeated_rows(texts, length)
    spans = repeated_spans(texts, repeated, length)
    keyed = rows.select("*", *_keys(id_col, text_col))
    if not repeated.limit(1).count():
        return keyed.join(spans, ["k", "th"], "left")
    return hot_left_join(keyed.withColumn("_at", F.monotonically_increasing_id()), spans, ["k", "th"], "_at", repeated.select("k", "th", "_rows")).drop("_at")


def _cut(own: np.ndarray, spans: list | None, length: int, whole_characters: bool) -> np.ndarray:
    """Which bytes of a text its repeated windows cover."""
    if not spans:
        return np.zeros(len(own), bool)
    change = np.zeros(len(own) + 1, np.int64)
    at, n = (np.array([s[f] for s in spans], np.int64) for f in ("at", "n"))
    np.add.at(change, at, 1)
    np.add.at(change, at + n + length - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    lead = np.flatnonzero((own & 0xC0) != 0x80) if whole_characters else []
    if len(lead):
        gone = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(own))))
    return gone


def cut_repeats(docs: DataFrame, length: int = 200, whole_characters: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that remain).

    ``whole_characters`` leaves every character of which a byte is not covered, so that ``kept`` is text.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    @lean
    def cut(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for i, (k, spans) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                own = data[offsets[i] : offsets[i + 1]]
                gone = _cut(own, spans, length, whole_characters)
                kept = own[~gone].tobytes()
                for column, value in zip(out, (k, len(own), int(gone.sum()), len(_runs(gone)[0]), hashlib.sha256(kept).hexdigest(), kept)):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    found = _with_spans(texts, "id", "text", length).select("id", "text", "spans")
    return found.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def without_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with whole characters of repeated strings cut out of their texts.

    Rows are dropped of which something was cut and nothing but white space is left.
    """
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(own, F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    extra = "spans"
    while extra in docs.columns:
        extra += "_"
    rows, at = _with_spans(keyed, "id", "text", length).select("row.*", F.col("spans").alias(extra)), docs.columns.index(text_col)

    @lean
    def cut(batches):
        import pyarrow as pa

        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            texts, keep = batch.column(at).to_pylist(), np.ones(batch.num_rows, bool)
            for i, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if spans:
                    own = np.frombuffer(texts[i].encode(), np.uint8)
                    gone = _cut(own, spans, length, True)
                    if gone.any():
                        texts[i] = own[~gone].tobytes().decode()
                        keep[i] = bool(texts[i].strip())
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1]).filter(pa.array(keep))

    return rows.mapInArrow(cut, docs.schema)


def suffix_report(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = cut_repeats(docs, length, False, id_col, text_col)
    return rows.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")
