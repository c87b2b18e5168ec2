"""N-gram Jaccard self-join with set relations, and the classes its links form.

A document's set holds its different 4-word shingles (64-bit hashes). Two documents link when
100 * intersection >= 85 * union. The join:

1. Equal sets collapse; one representative goes on.
2. Shingles are ordered by corpus frequency, rare first: a sketch of 2^20 counters over all documents
   (its size does not depend on the data) tells common shingles from rare ones. Linked sets share a
   shingle among the first n - ceil(0.85 n) + 1 of each, which form the inverted lists.
3. Leaders: each list has one leader for a class of sizes, and each set meets the few leaders it shares most
   lists with. In a task a leader's whole set lies beside its members', and their differences from it are
   taken. The answers among members follow from those differences alone, since x and y differ in
   d(x, leader) + d(y, leader) - 2 |both differences| shingles; no member is compared with another as a whole.
4. Lists are sorted by set size, then position. Blocks of sets (one size) are entered only up to the
   position from which the bound on the intersection fails; whole blocks fall away. Only pairs whose classes
   still differ go on, so near copies of one text are not all compared with each other: first the best pair of
   a set and a class, then, of classes that have not met, all.
5. A bitmap of parities of each set (half a bit a shingle at least) bounds the difference of two sets from
   below, so most pairs that do not link are dropped without fetching their sets. The others are decided
   exactly on their whole sets; classes are connected components.

A list held by very many sets is dealt over tasks: sets of its largest class once, all others to each of them
(or, where the others are many too, all to pairs of parts).

Documents without words (or null) have an empty set and link with nothing; shorter ones than four words
are one shingle. Repeated rows share a class. Frequencies only set the order, so results do not
depend on the sketch. Extra columns are ignored; an empty table gives no rows.

Ids may be null or shared by different texts: a text is fetched by ``key``, a hash of id and text, and what
comes is checked against the set's signature. A class is named by its smallest id that is not null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import forget, hot_left_join, lean, stored
from ._hashing import Powers, byte_class, grams, in_chunks, mix, text_buffers, words_of

IS_WORD = byte_class(outside=bytes([0x20, *range(0x09, 0x0E)]))
SKETCH = 1 << 20
CHUNK = 1024  # counters of a row
SENT_MOST = 200_000  # requests for texts that may be broadcast (100 bytes each in memory, so 20 MB); more are joined by shuffle
LIST_BLOCK = 4096  # entries of an inverted list that one task pairs
WORDS = 8  # 64-bit words of a bitmap of a set of up to 128 shingles a word; twice as many for each doubling
SHORT = 32  # entries of a list whose pairs are taken by shifting
LEADERS = 3  # leaders that a set is compared with
PAIRS = 1 << 20  # pairs (40 bytes each) that a task gathers before it hands their different ones on
GROUP = 256  # sets that are compared with one of another in a task


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, powers: Powers) -> list[np.ndarray]:
    """The sorted different shingles of every text of a chunk."""
    words, first = words_of(data, offsets, IS_WORD, powers)
    hashes = grams(words, k)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            sets.append(np.unique(hashes[a : b - k + 1]))
        elif b > a:
            sets.append(mix(grams(words[a:b], b - a) + np.uint64(b - a)))  # the whole sequence as one
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signature(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def parities(s: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the number of members that hash to i: two sets differ in at least as many members as their bitmaps in bits.

    Sizes are powers of two: the larger of two bitmaps is folded, by the exclusive or of its halves, to the smaller one's.
    """
    words = WORDS << max(0, (len(s) - 1).bit_length() - (WORDS * 128 - 1).bit_length())
    flips = np.bincount(((s >> np.uint64(20)) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


class Bitmaps:
    """Bitmaps of several sets, of different sizes."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray):
        self.words, self.offsets, self.size = words, offsets, np.diff(offsets)
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _at(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of each set, matrix) of the bitmaps of this size and of twice this size, folded."""
        if size not in self.folded:
            place, parts, n = np.full(len(self.size), -1, np.int64), [], 0
            for own in (size, 2 * size):
                rows = np.flatnonzero(self.size == own)
                m = self.words[self.offsets[rows][:, None] + np.arange(own)]
                parts.append(m if own == size else m[:, :size] ^ m[:, size:])
                place[rows] = n + np.arange(len(rows))
                n += len(rows)
            self.folded[size] = place, np.concatenate(parts)
        return self.folded[size]

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of pairs of sets, in how many bits they differ; 0 where one bitmap is over twice as long as the other."""
        out, smaller, larger = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y]), np.maximum(self.size[x], self.size[y])
        for size in np.unique(smaller).tolist():
            some = np.flatnonzero((smaller == size) & (larger <= 2 * size))
            place, m = self._at(size)
            for at in range(0, len(some), step := max(1, (1 << 22) // size)):
                part = some[at : at + step]
                out[part] = np.bitwise_count(m[place[x[part]]] ^ m[place[y[part]]]).sum(axis=1, dtype=np.int64)
        return out


def _sets_in(batch, column: int, k: int, powers: Powers):
    """(row, set) of every text of a batch."""
    for row, data, offsets in in_chunks(*text_buffers(batch.column(column))):
        for i, s in enumerate(shingle_sets(data, offsets, k, powers)):
            yield row + i, s


def _shapes(texts: DataFrame, k: int) -> DataFrame:
    """Rows (id, key, n, sig, bits) of every document (id, text, key), and rows (chunk, counts) of each task's sketch of shingle frequencies."""

    @lean
    def shape(batches):
        import pyarrow as pa

        powers, counts = Powers(), np.zeros(SKETCH, np.int64)
        names = ["id", "key", "n", "sig", "bits", "chunk", "counts"]
        for batch in batches:
            n, sig = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            bits, pending, size = [], [], 0
            for row, s in _sets_in(batch, 1, k, powers):
                n[row], sig[row] = len(s), signature(s)
                bits.append(parities(s))
                pending.append(s)
                size += len(s)
                if size > 1 << 20:
                    counts += np.bincount((np.concatenate(pending) >> np.uint64(44)).astype(np.int64), minlength=SKETCH)
                    pending, size = [], 0
            if pending:
                counts += np.bincount((np.concatenate(pending) >> np.uint64(44)).astype(np.int64), minlength=SKETCH)
            nothing = pa.nulls(batch.num_rows)
            ends = np.cumsum([0, *(len(b) for b in bits)])
            rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bits) if bits else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(sig), rows, nothing.cast(pa.int32()), nothing.cast(pa.binary())], names=names)
        if counts.any():
            parts = counts.reshape(-1, CHUNK)
            some = np.flatnonzero(parts.any(axis=1))
            nothing = pa.nulls(len(some))
            rows = [parts[i].astype("<i8").tobytes() for i in some]
            yield pa.RecordBatch.from_arrays([nothing.cast(pa.int64()), nothing.cast(pa.int64()), nothing.cast(pa.int32()), nothing.cast(pa.int64()), nothing.cast(pa.list_(pa.int64())), pa.array(some.astype(np.int32)), pa.array(rows, pa.binary())], names=names)

    return texts.mapInArrow(shape, "id long, key long, n int, sig long, bits array<long>, chunk int, counts binary")


def _common_classes(shapes: DataFrame) -> np.ndarray:
    """For every counter, how far (in powers of two) it lies above the mean: one byte each."""

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["chunk", "counts"])

    total = np.zeros((SKETCH // CHUNK, CHUNK))
    parts = shapes.filter("chunk is not null").select("chunk", "counts")
    for r in parts.repartition(F.col("chunk")).mapInArrow(add, "chunk int, counts binary").collect():  # SKETCH counters
        total[r["chunk"]] = np.frombuffer(r["counts"], "<i8")
    total = total.ravel()
    mean = max(1.0, float(total.mean()))
    return np.clip(np.floor(np.log2(np.maximum(total, 1) / mean)), 0, 63).astype(np.uint8)


def _lists(texts: DataFrame, k: int, percent: int, classes) -> DataFrame:
    """(token, sig, n, pos): inverted lists over prefixes, of two or more different sets each."""

    @lean
    def prefixes(batches):
        import pyarrow as pa

        powers, common, seen = Powers(), classes.value, set()
        for batch in batches:
            out, meta = [], []

            def ready():
                sizes = np.array([len(t) for t in out])
                sig, n = (np.repeat(np.array([m[i] for m in meta], t), sizes) for i, t in ((0, np.int64), (1, np.int32)))
                pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(sig), pa.array(n), pa.array(pos.astype(np.int32))], names=["token", "sig", "n", "pos"])

            for _, s in _sets_in(batch, 1, k, powers):
                n = len(s)
                sig = signature(s) if n else 0
                if not n or sig in seen:  # copies within a task collapse here
                    continue
                seen.add(sig)
                ordered = (common[s >> np.uint64(44)].astype(np.uint64) << np.uint64(58)) | (mix(s) >> np.uint64(6))
                take = n - -(-percent * n // 100) + 1
                ordered = np.sort(np.partition(ordered, take - 1)[:take]) if take < n else np.sort(ordered)
                out.append(ordered)
                meta.append((sig, n))
                if len(out) >= 4096:
                    yield ready()
                    out, meta = [], []
            if out:
                yield ready()

    @lean
    def shared(batches):
        """Of rows sorted by token and set, the different ones of lists with more than one set."""
        import pyarrow as pa

        held = None  # the last list so far, while it has one set
        last = None  # the last token and set, once the list is known to be shared
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                held = None
            token, sig = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(token):
                continue
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])])
            if last is not None and (token[0], sig[0]) == last:
                new[0] = False
            begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            many = np.maximum.reduceat(sig, begin) != np.minimum.reduceat(sig, begin)
            if last is not None and token[0] == last[0]:
                many[0] = True
            keep = np.repeat(many, np.diff(np.append(begin, len(token)))) & new
            last = (token[-1], sig[-1]) if many[-1] else None
            if last is None:
                held = batch.slice(int(begin[-1]), 1)  # rows of one set alike
            found = np.flatnonzero(keep)
            if len(found):
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(found)) for i in range(4)], names=["token", "sig", "n", "pos"])

    schema = "token long, sig long, n int, pos int"
    rows = texts.mapInArrow(prefixes, schema)
    return rows.repartition(F.col("token")).sortWithinPartitions("token", "sig").mapInArrow(shared, schema)


def _passes(a: str, b: str, percent: int):
    """Size filter and position filter for a pair of list entries."""
    na, nb, pa_, pb = (F.col(f"{s}.{f}") for f in ("n", "pos") for s in (a, b))
    least = F.ceil(percent * (na + nb) / (100 + percent))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (F.least(na - pa_, nb - pb) >= least)


def _near_enough(na: Column, nb: Column, x: Column, y: Column, percent: int) -> Column:
    """Whether two bitmaps leave room for a link."""

    def fold(v):
        half = F.floor(F.size(v) / 2).cast("int")
        return F.zip_with(F.slice(v, F.lit(1), half), F.slice(v, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    x, y = F.when(F.size(x) > F.size(y), fold(x)).otherwise(x), F.when(F.size(y) > F.size(x), fold(y)).otherwise(y)
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, v: a + v)
    return (F.size(x) != F.size(y)) | ((100 + percent) * apart <= (100 - percent) * (na + nb))


def _leader_pairs(lists: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b): every set with the LEADERS leaders it meets most often.

    A leader is the entry of a size class of a list that stands first in its set: few rarer shingles come
    before, so it differs least from what the list's sets have in common.
    """
    cls = F.floor(F.log(F.col("n")) / F.lit(float(np.log(100 / percent)))).cast("int")
    rows = lists.withColumn("cls", cls)
    leaders = rows.groupBy("token", "cls").agg(F.min(F.struct("pos", "sig", "n")).alias("l")).select("token", "cls", "l.*")
    leaders = leaders.withColumn("cls", F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)))
    met = rows.alias("x").join(leaders.alias("y"), ["token", "cls"]).filter("x.sig != y.sig").filter(_passes("x", "y", percent))
    met = met.groupBy(F.col("x.sig").alias("a"), F.col("y.sig").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).count()
    order = Window.partitionBy("a").orderBy(F.desc("count"), "b")
    met = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= LEADERS)
    known = members.select("sig", "bits")
    met = met.join(known.toDF("a", "x"), "a").join(known.toDF("b", "y"), "b")
    return met.filter(_near_enough(F.col("na"), F.col("nb"), F.col("x"), F.col("y"), percent)).select("a", "b")


def block_pairs(n: np.ndarray, pos: np.ndarray, label: np.ndarray, percent: int, most: int = 1 << 20):
    """Index pairs (i, j) of one list's entries with different labels that pass the filters; entries sorted by size, then position.

    Blocks are the entries of one size. For entry i and block b, positions beyond size_b - bound are skipped
    at once, and so is the block where nothing is left.
    """
    sizes, begin = np.unique(n, return_index=True)
    end = np.append(begin[1:], len(n))
    wide = np.int64(n.max()) + 1
    place = n.astype(np.int64) * wide + pos
    own = np.searchsorted(sizes, n)
    limit = np.searchsorted(sizes, (n.astype(np.int64) * 100) // percent, "right")
    step = max(1, most // max(1, len(n)))
    for at in range(0, len(n), step):
        i = np.arange(at, min(len(n), at + step))
        blocks = np.maximum(limit[i] - own[i], 0)
        who = np.repeat(i, blocks)
        b = np.repeat(own[i], blocks) + np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        bound = -(-percent * (n[who].astype(np.int64) + sizes[b]) // (100 + percent))
        ok = n[who] - pos[who] >= bound
        who, b, bound = who[ok], b[ok], bound[ok]
        low = np.maximum(begin[b], who + 1)
        high = np.searchsorted(place, sizes[b].astype(np.int64) * wide + (sizes[b] - bound), "right")
        count = np.maximum(np.minimum(high, end[b]) - low, 0)
        x = np.repeat(who, count)
        y = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        differ = label[x] != label[y]
        yield x[differ], y[differ]


def _remaining_pairs(lists: DataFrame, members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b, la, lb, apart) of all list entries whose classes (la, lb) differ and whose filters pass; apart: bits that differ, in thousandths of both sizes."""
    rows = _labelled(lists, labels, "sig", "label")
    mixed = rows.groupBy("token").agg(F.count(F.lit(1)).alias("entries"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    mixed = mixed.select("token", F.ceil(F.col("entries") / LIST_BLOCK).cast("int").alias("parts"))
    # Of long lists, the largest class and how many entries are of others.
    long = rows.join(mixed.filter("parts > 1").select("token"), "token", "left_semi").groupBy("token", "label").count()
    long = long.groupBy("token").agg(F.max_by("label", F.struct("count", "label")).alias("top"), (F.sum("count") - F.max("count")).alias("others"))
    rows = rows.join(mixed.join(long, "token", "left"), "token")
    own = F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    cell = lambda p, q: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"))
    cells = F.when(F.col("parts") == 1, F.array(cell(F.lit(0), F.lit(0))))
    cells = cells.when((F.col("others") <= LIST_BLOCK) & (F.col("label") == F.col("top")), F.array(cell(own, own)))
    cells = cells.when(F.col("others") <= LIST_BLOCK, F.transform(every, lambda i: cell(i, i)))
    cells = cells.otherwise(F.transform(every, lambda i: cell(F.least(own, i), F.greatest(own, i))))
    rows = rows.withColumn("cell", F.explode(cells)).select("token", "cell.p", "cell.q", "n", "pos", "sig", "label")
    rows = rows.join(members.select("sig", "bits"), "sig").select("token", "p", "q", "n", "pos", "sig", "label", "bits")

    @lean
    def pair(batches):
        import pyarrow as pa

        def work(columns, words, ends):
            """Pairs of whole lists: of short ones by shifting all of them at once, of long ones by blocks."""
            token, p, q, n, pos, sig, label = columns
            if not len(token):
                return
            bits = Bitmaps(words, ends)
            begin = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]))
            size = np.diff(np.append(begin, len(token)))
            which = np.repeat(np.arange(len(begin)), size)
            short = (size <= SHORT)[which]
            found, size_found = [], 0

            def pairs_of(found):
                """The different ones of the pairs so far; a task never holds more than PAIRS of them before."""
                pairs = np.unique(np.stack([np.concatenate(v) for v in zip(*found)], axis=1), axis=0)
                return pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in range(5)], names=["a", "b", "la", "lb", "apart"])

            def keep(x, y):
                x, y = (v[label[x] != label[y]] for v in (x, y))
                low, high = np.minimum(n[x], n[y]).astype(np.int64), np.maximum(n[x], n[y]).astype(np.int64)
                bound = -(-percent * (low + high) // (100 + percent))
                ok = (100 * low >= percent * high) & (np.minimum(n[x] - pos[x], n[y] - pos[y]) >= bound)
                x, y, total = x[ok], y[ok], (low + high)[ok]
                apart = bits.apart(x, y)
                ok = (100 + percent) * apart <= (100 - percent) * total
                if ok.any():
                    x, y = x[ok], y[ok]
                    swap = sig[x] > sig[y]
                    x, y = np.where(swap, y, x), np.where(swap, x, y)
                    found.append((sig[x], sig[y], label[x], label[y], 1000 * apart[ok] // total[ok]))
                    return len(x)
                return 0

            for shift in range(1, int(min(size.max(), SHORT))):
                x = np.flatnonzero((which[shift:] == which[:-shift]) & short[:-shift])
                size_found += keep(x, x + shift)
                if size_found > PAIRS:
                    yield pairs_of(found)
                    found.clear()
                    size_found = 0
            for i in np.flatnonzero(size > SHORT).tolist():
                at, to = int(begin[i]), int(begin[i] + size[i])
                for x, y in block_pairs(n[at:to], pos[at:to], label[at:to], percent):
                    size_found += keep(x + at, y + at)
                    if size_found > PAIRS:
                        yield pairs_of(found)
                        found.clear()
                        size_found = 0
            if found:
                yield pairs_of(found)

        def parts(batch):
            column = batch.column(7)
            ends = column.offsets.to_numpy().astype(np.int64)
            return [batch.column(i).to_numpy() for i in range(7)], column.flatten().to_numpy().view(np.uint64), ends - ends[0]

        held = None  # rows of the last list, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            token, p, q = (batch.column(i).to_numpy() for i in range(3))
            same = (token == token[-1]) & (p == p[-1]) & (q == q[-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield from work(*parts(batch.slice(0, cut)))
            held = batch.slice(cut)
        if held is not None:
            yield from work(*parts(held))

    dealt = rows.repartition(F.col("token"), F.col("p"), F.col("q")).sortWithinPartitions("token", "p", "q", "n", "pos")
    return dealt.mapInArrow(pair, "a long, b long, la long, lb long, apart long").distinct()


def _labelled(rows: DataFrame, labels: DataFrame, sig: str, label: str) -> DataFrame:
    """Adds the class of a set; a set without links is one of its own."""
    return rows.join(labels.toDF(sig, label), sig, "left").withColumn(label, F.coalesce(label, sig))


def _linked(pairs: DataFrame, members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) of sets that link, enough to connect all pairs (a, b) that do; members: sig, key of one document of each set,
    and, where rows repeat, whether several have that key.

    The whole set of b meets those of its partners a in groups of GROUP. What a partner and b differ in decides
    whether they link; for partners that do not, it also tells whether they link with another of the group.
    """
    pairs = stored(pairs, "pairs")
    dealt = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"))
    dealt = pairs.join(dealt, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    asked = dealt.select(F.col("a").alias("sig"), "b", "part", F.lit(1).alias("role")).union(dealt.select("b", "b", "part", F.lit(0)).distinct())
    asked = stored(asked.join(members, "sig"), "asked")
    wanted = texts.join(F.broadcast(asked) if asked.count() <= SENT_MOST else asked, "key")
    if "many" in asked.columns:  # copies with one key collapse before they meet
        columns = ["b", "part", "role", "sig", "text"]
        wanted = wanted.filter("many").select(columns).distinct().union(wanted.filter("not many").select(columns))

    @lean
    def compare(batches):
        import pyarrow as pa

        powers, found, group = Powers(), [], []
        now = whole = None

        def links(n: int, d: int) -> bool:
            """Whether sets of n members together, of which d are not shared, link."""
            return 100 * (n - d) >= percent * (n + d)

        def close():
            parent: dict[int, int] = {}

            def top(v):
                while parent.get(v, v) != v:
                    parent[v] = v = parent.get(parent[v], parent[v])
                return v

            alone = []
            for i, (sig, n, rest) in enumerate(group):
                if links(n + len(whole), len(rest)):
                    parent[sig] = now[0]
                    found.append((sig, now[0]))
                else:
                    alone.append(i)
            n, d = (np.array([f(g) for g in group], np.int64) for f in (lambda g: g[1], lambda g: len(g[2])))
            for i in alone:
                sig, own, rest = group[i]
                most = own + n - np.abs(len(rest) - d)  # twice the largest intersection that the differences' sizes allow
                for j in np.flatnonzero(100 * most >= percent * (2 * (own + n) - most)).tolist():
                    other = group[j][0]
                    if top(sig) != top(other) and links(own + int(n[j]), len(rest) + int(d[j]) - 2 * len(np.intersect1d(rest, group[j][2], assume_unique=True))):
                        parent[top(sig)] = top(other)
                        found.append((sig, other))
            group.clear()

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            for i, s in _sets_in(batch, 4, k, powers):
                b, part, role, sig = keys[i]
                if (b, part) != now:
                    close()
                    now, whole = (b, part), None
                if signature(s) != sig:  # another text of the same key
                    continue
                if not role:
                    whole = s
                elif whole is not None:
                    group.append((sig, len(s), np.setxor1d(s, whole, assume_unique=True)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])
                found.clear()
        close()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    met = wanted.select("b", "part", "role", "sig", "text").repartition(F.col("b"), F.col("part")).sortWithinPartitions("b", "part", "role")
    links = stored(met.mapInArrow(compare, "a long, b long"), "links")
    forget(pairs, asked)
    return links


def classes_of(links: DataFrame) -> DataFrame:
    """(id, label): the least id reachable by links (a, b), of all ids in links.

    Labels fall to the least among neighbours, then to their label's label, until nothing changes; every
    round is a table in the shared folder, dropped after the next.
    """
    both = stored(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("m"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("top"))
        after = stored(lower.join(up, "label").select("id", "was", F.least("label", "top").alias("label")), "labels")
        changed = after.filter("label != was").limit(1).count()
        forget(labels)
        labels = after.select("id", "label")
        if not changed:
            forget(both)
            return labels


def _towards_hubs(pairs: DataFrame) -> DataFrame:
    """(a, b) turned so that b is the set with more partners, whose text then travels for many of them."""
    degree = pairs.select("a").union(pairs.select("b")).groupBy("a").count()
    both = pairs.join(degree.toDF("a", "na"), "a").join(degree.toDF("b", "nb"), "b")
    turned = F.struct("na", "a") > F.struct("nb", "b")
    return both.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (all of it), id, text (null is empty) and key, which is equal for rows equal in both."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("key", F.xxhash64("id", "text"))


def _classed(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id, key, n, label, component_id of every document: label tells the classes apart, component_id is the smallest id in it that is not null."""
    texts = _keyed(docs.select(id_col, text_col), id_col, text_col).select("id", "text", "key")
    shapes = stored(_shapes(texts, k), "shapes")
    classes = docs.sparkSession.sparkContext.broadcast(_common_classes(shapes))
    rows = shapes.filter("chunk is null").select("id", "key", "n", "sig")
    least = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key", "bits"))
    members = shapes.filter("n > 0").groupBy("sig").agg(least.alias("m")).select("sig", "m.id", "m.key", "m.bits")  # equal sets collapse
    members = stored(members, "members")
    lists = stored(_lists(texts.select("id", "text"), k, percent, classes), "lists")

    ids = members.select("sig", "key")
    repeated = stored(rows.filter("n > 0").groupBy("key").count().filter("count > 1").select("key", F.lit(True).alias("many")), "repeated")
    if repeated.limit(1).count():
        ids = stored(ids.join(repeated, "key", "left").select("sig", "key", F.coalesce("many", F.lit(False)).alias("many")), "ids")
    links = _linked(_leader_pairs(lists, members, percent), ids, texts, k, percent)
    labels = classes_of(links)
    pairs = stored(_remaining_pairs(lists, members, labels, percent), "remaining")
    forget(lists)
    best = lambda x, y, own, other: F.row_number().over(Window.partitionBy(x, other).orderBy("apart", y)) == 1
    first = pairs.withColumn("of_a", best("a", "b", "la", "lb")).withColumn("of_b", best("b", "a", "lb", "la")).filter("of_a and of_b")
    links = links.union(_linked(first.select("a", "b"), ids, texts, k, percent))
    labels = classes_of(links)
    still = _labelled(_labelled(pairs.select("a", "b"), labels, "a", "la"), labels, "b", "lb").filter("la != lb")
    still = stored(still.join(first.select("a", "b"), ["a", "b"], "left_anti"), "still")
    if still.limit(1).count():
        links = links.union(_linked(_towards_hubs(still), ids, texts, k, percent))
        labels = classes_of(links)
    forget(pairs, still)

    # Classes of signatures, named by their smallest document.
    named = members.select("sig", "id").join(labels.withColumnRenamed("id", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    smallest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    named = named.join(smallest, "label").select("sig", "label", "component_id")
    joined = hot_left_join(rows.withColumn("_at", F.monotonically_increasing_id()), named, ["sig"], "_at")
    return joined.select("id", "key", "n", "label", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def jaccard_classes(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links; null if no document of the class has an id)."""
    rows = _classed(docs, k, percent, id_col, text_col)
    return rows.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_per_class(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of ``docs``, all columns, of the smallest id of each class; of different texts that share that id, one by hash.

    A class without ids keeps one row too. Documents without words link with nothing: only repeated rows of one id collapse,
    and all rows without an id stay. The rows themselves travel once.
    """
    rows = _classed(docs, k, percent, id_col, text_col).filter(F.col("id").eqNullSafe(F.col("component_id")))
    rows = rows.select("key", "id", (F.col("n") == 0).alias("empty"), F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("key")).alias("class"))
    each = rows.groupBy("empty", "class", "id", "key").agg(F.count(F.lit(1)).alias("rows"))
    chosen = each.groupBy("empty", "class", "id").agg(F.min(F.struct("key", "rows")).alias("m"))
    alone = F.col("empty") & F.col("id").isNull()
    kept = stored(chosen.select(F.col("m.key").alias("key"), F.col("id").alias("own"), ((F.col("m.rows") > 1) & ~alone).alias("many")), "kept")
    keyed = _keyed(docs, id_col, text_col)
    meets = (keyed["key"] == kept["key"]) & keyed["id"].eqNullSafe(kept["own"])
    found = keyed.join(kept.filter("not many"), meets, "left_semi").select("row.*")
    if kept.filter("many").limit(1).count():  # of repeated rows one stays
        again = keyed.join(kept.filter("many"), meets, "left_semi").groupBy("key", "id").agg(F.first("row").alias("row"))
        found = found.union(again.select("row.*"))
    return found
