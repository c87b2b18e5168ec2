"""Best-fit packing of tokenised documents into sequences.

Documents become pieces of at most ``capacity`` tokens. The histogram of piece lengths (at most
``capacity`` counts, whatever the corpus) goes to the driver, where the configuration linear program
- cover every length's count with as few patterns of total length <= capacity as possible - is solved
by multiplicative weights: each step prices lengths by their weights, finds the dearest patterns by
knapsack dynamic programming, and lowers the weights of lengths that they cover above their share. The mean
of the steps' patterns is the program's solution, and every step's prices, divided by the dearest pattern's
worth, are a dual solution that bounds the number of sequences from below. Pattern counts are rounded to
whole patterns that the histogram can fill, and only what remains is packed by best fit. Pieces then find
their places by (length, rank) in the resulting table of runs, in parallel.

Null texts are empty documents of one closing token; empty tables give no rows; repeated rows and rows without
an id are packed as often as they occur. Long documents are encoded whole and only cut where they exceed the
capacity. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import shuffle_partitions, stored, worker_store

# ---------------------------------------------------------------------------- tokens

_L = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xffĀ-į"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = " \t\n\r\x0b\x0c"
_BEYOND = re.compile("[^\x09-\x0d\x20-\x7e\xa1-į]|<\\|")
_KNOWN_MOST = 1_500_000  # words kept by a worker process


def word_pattern(settings: dict) -> re.Pattern | None:
    """How a tokenizer file's settings cut lower-cased texts of Latin letters below U+0130 into words, its pattern's classes spelled out.

    None where the settings let neighbouring words matter: normalisers other than composition, white space and lower case,
    other cuts than by one pattern whose matches are the words, or added tokens that do not begin with "<|".
    """
    normal = [(n.get("type"), n.get("content")) for n in (settings.get("normalizer") or {}).get("normalizers", [])]
    cuts = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = normal == [("NFC", None), ("Replace", " "), ("Lowercase", None)] and settings["normalizer"]["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
    plain = plain and [c.get("type") for c in cuts] == ["Split", "ByteLevel"] and (cuts[0]["behavior"], cuts[0]["invert"]) == ("Removed", True)
    plain = plain and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"] and settings.get("post_processor") is None
    if not plain or any(not t["content"].startswith("<|") for t in settings["added_tokens"]):
        return None
    pattern = cuts[0]["pattern"].get("Regex", "\\")
    for own, spelled in ((r"\p{L}", _L), (r"\p{N}", _N), (r"\s", _S)):
        pattern = pattern.replace(own, spelled)
    return None if "\\" in pattern else re.compile(pattern)


class WordTokenizer:
    """Ids of texts by a tokenizer whose words do not influence each other, each different word encoded once.

    Texts with anything outside the spelled-out range go to the library whole, as do all where the file's settings are others.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        with open(path, encoding="utf-8") as f:
            self.pattern = word_pattern(json.load(f))
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > _KNOWN_MOST:
            self.known.clear()
        for i in range(0, len(words), 2048):
            part = words[i : i + 2048]
            for w, e in zip(part, self.model.encode_batch(part, add_special_tokens=False)):
                self.known[w] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.pattern is None or _BEYOND.search(text):
            return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = self.pattern.findall(text.lower())
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > _KNOWN_MOST:
                self.known.clear()
            self._learn(list(set(words).difference(self.known)))
            return b"".join(map(self.known.__getitem__, words))


def word_tokenizer(path: str) -> WordTokenizer:
    loaded = worker_store("word-tokenizers")
    if path not in loaded:
        loaded[path] = WordTokenizer(path)
    return loaded[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of every piece."""

    def cut(batches):
        import zlib

        import pyarrow as pa

        tokenizer, end = word_tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = tokenizer(text or "") + end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, p, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(out, types))[: 5 + with_ids]], names=names[: 5 + with_ids])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


# ---------------------------------------------------------------------------- the linear program


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to ``capacity``, the most that lengths (with repetition) in it are worth and the length to take first (0: leave one token empty); prices[L] is the price of length L."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    falling = prices[:0:-1].copy()  # longest first, so that of equals the longest is taken
    for room in range(1, capacity + 1):
        worth = best[:room] + falling[capacity - room :]
        at = int(worth.argmax())
        if worth[at] > best[room - 1]:
            best[room], pick[room] = worth[at], room - at
        else:
            best[room] = best[room - 1]
    return best, pick


def dear_patterns(best: np.ndarray, prices: np.ndarray, wish: np.ndarray, slack: float, draws: int, rng: np.random.Generator) -> dict[bytes, int]:
    """Patterns (sorted lengths, 16 bits) whose worth is within ``slack`` of the dearest, and how often each was drawn.

    The lengths of a pattern are drawn one after the other by ``wish``, from those after which the rest of the room, filled
    as dear as can be, still comes within the slack. ``best`` is the knapsack's table for ``prices``.
    """
    lengths, capacity = np.flatnonzero(prices > 0), len(best) - 1
    price, want = prices[lengths], wish[lengths]
    rows: list[np.ndarray] = []
    for at in range(0, draws, 128):
        n = min(128, draws - at)
        room, spare, taken = np.full(n, capacity), np.full(n, slack * best[capacity]), []
        while room.any():
            after = room[:, None] - lengths
            loss = np.where(after >= 0, best[room][:, None] - price - best[np.maximum(after, 0)], np.inf)
            likely = np.cumsum(np.where(loss <= spare[:, None] + 1e-12, want, 0.0), axis=1)
            pick = (likely < (rng.random(n) * likely[:, -1])[:, None]).sum(axis=1)
            some = likely[:, -1] > 0
            pick = np.minimum(pick, len(lengths) - 1)
            take = np.where(some, lengths[pick], 0)
            spare = spare - np.where(some, np.maximum(loss[np.arange(n), pick], 0), 0)
            room = np.where(some, room - take, 0)  # nothing fits any more: the rest stays empty
            taken.append(take)
        rows.append(-np.sort(-np.stack(taken, axis=1), axis=1))
    found: dict[bytes, int] = {}
    for block in rows:
        for row in block.astype("<u2"):
            p = row[row > 0].tobytes()
            found[p] = found.get(p, 0) + 1
    return found


def configuration_lp(counts: np.ndarray, capacity: int, steps: int = 12, draws: int = 256, eta: float = 0.02, slack: float = 0.002, seed: int = 5) -> tuple[dict[bytes, float], np.ndarray, float]:
    """(patterns and how often each is used to cover ``counts``, the best step's prices, the lower bound of the number of sequences that they prove).

    Two players: one weighs lengths, the other answers with patterns. Weights begin as the lengths' volumes,
    so prices begin as length / capacity, the dual solution of the volume bound. A length covered c times its share has its
    weight multiplied by exp(eta * (1 - c)), c cut at 2. An answer spreads over ``draws`` patterns within ``slack`` of the
    dearest; the lengths drawn most are those that answers so far have covered least. The mean is of the second half of the steps.
    """
    lengths, need, rng = np.arange(capacity + 1), counts.astype(float), np.random.default_rng(seed)
    has = need > 0
    weight, wish, used, bound = np.ones(capacity + 1), need * lengths, {}, 0.0
    dual = np.zeros(capacity + 1)
    for step in range(steps if has.any() else 0):
        prices = np.where(has, lengths / capacity * weight, 0.0)
        best, _ = knapsack(prices, capacity)
        now_bound = float((prices * need).sum()) / float(best[capacity])
        if now_bound > bound:
            bound, dual = now_bound, prices
        patterns = dear_patterns(best, prices, wish, slack, draws, rng)
        each = now_bound / draws
        held = [np.frombuffer(p, "<u2").astype(np.int64) for p in patterns]
        now = np.bincount(np.concatenate(held), np.repeat([each * n for n in patterns.values()], [len(h) for h in held]), minlength=capacity + 1)
        if step >= steps // 2:
            for p, n in patterns.items():
                used[p] = used.get(p, 0.0) + each * n / (steps - steps // 2)
        # Lengths of like size share what was drawn of them, as a single one is drawn too seldom to judge.
        ends = np.unique((np.arange(1, 65) * (capacity + 1)) // 64)
        group = np.searchsorted(ends, lengths, "right")
        ratio = (np.bincount(group, need) + 1e-9) / np.maximum(np.bincount(group, now), 0.25 * np.bincount(group, need) + 1e-9)
        wish *= np.clip(ratio, 0.25, 4)[group] ** 0.7
        weight *= np.exp(eta * (1 - np.minimum(now / np.maximum(need, 1), 2.0)))
    return used, dual, bound


def _fill(patterns: dict[bytes, int], left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """The patterns, as often as asked for and as ``left`` can fill them; it is reduced by them."""
    out = []
    for p, times in patterns.items():
        own, n = np.unique(np.frombuffer(p, "<u2").astype(np.int64), return_counts=True)
        times = min(times, int((left[own] // n).min()))
        if times > 0:
            left[own] -= n * times
            row = np.zeros(capacity + 1, np.int64)
            row[own] = n
            out.append((row, times))
    return out


def rounded(patterns: dict[bytes, float], prices: np.ndarray, left: np.ndarray, capacity: int, slack: float = 0.002, draws: int = 128, share: float = 0.05, seed: int = 6):
    """Lists of whole patterns that ``left`` can fill (it is reduced by them), one list after the other.

    First the program's patterns as often as it says, rounded down. What that leaves is rounded at random: patterns
    within ``slack`` of the dearest are drawn by what remains, ``draws`` at a time for ``share`` of it, until few of the drawn fit.
    """
    yield _fill({p: int(x) for p, x in sorted(patterns.items(), key=lambda item: (-item[1], item[0])) if x >= 1}, left, capacity)
    rng, lengths, poor = np.random.default_rng(seed), np.arange(capacity + 1), 0
    while poor < 3 and left.any():
        now = np.where(left > 0, prices, 0.0)
        best, _ = knapsack(now, capacity)
        found = dear_patterns(best, now, left * lengths, slack, draws, rng)
        times = max(1, int(share * (left * lengths).sum() / capacity / draws))
        more = _fill({p: n * times for p, n in found.items()}, left, capacity)
        poor = poor + 1 if sum(t for _, t in more) < draws * times // 8 else 0
        if more:
            yield more


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Best-fit decreasing over a histogram: fill each sequence with the longest piece that still fits, many alike at a time."""
    left, packed = counts.copy(), []
    present = np.flatnonzero(left).tolist()
    while present:
        pattern, room = {}, capacity
        at = len(present) - 1
        while room and at >= 0:
            length = present[at]
            if length <= room:
                n = min(room // length, int(left[length]))
                pattern[length] = n
                room -= n * length
            at -= 1
        times = min(int(left[k]) // n for k, n in pattern.items())
        row = np.zeros(capacity + 1, np.int64)
        for k, n in pattern.items():
            row[k] = n
            left[k] -= n * times
        packed.append((row, times))
        present = [k for k in present if left[k]]
    return packed


def pack_histogram(counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole patterns and how often each is used; every length is used exactly as often as it occurs.

    The program is solved and rounded, and best fit packs what remains: once at every tenth of the sequences that the rounding
    has filled. The packing with the fewest sequences is kept, of equals that in which the program carries most.
    """
    patterns, prices, bound = configuration_lp(counts, capacity)
    left, done, carried = counts.astype(np.int64).copy(), 0, []
    best, fewest, tried = best_fit(left, capacity), None, 0.0
    fewest = sum(t for _, t in best)

    def attempt():
        nonlocal best, fewest
        rest = best_fit(left, capacity)
        if done + sum(t for _, t in rest) <= fewest:
            best, fewest = carried + rest, done + sum(t for _, t in rest)

    for more in rounded(patterns, prices, left, capacity):
        carried = carried + more
        done += sum(t for _, t in more)
        if done >= tried + 0.1 * bound:
            tried = done
            attempt()
    attempt()
    return best


# ---------------------------------------------------------------------------- places


def runs_of(packing: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, pieces of this length a sequence, offset of the first)."""
    used: dict[int, int] = {}
    runs, sequence = [], 0
    for pattern, times in packing:
        offset = 0
        for length in np.flatnonzero(pattern)[::-1].tolist():
            n, rank = int(pattern[length]), used.get(length, 0)
            runs.append((length, rank, n * times, sequence, n, offset))
            used[length] = rank + n * times
            offset += n * length
        sequence += times
    return runs


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to stored pieces with a column ``length``."""
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    runs = runs_of(pack_histogram(counts, capacity))

    # Ranks within a length: inside hashed parts of a length, after the sizes of the parts before.
    parts = shuffle_partitions(spark)
    rows = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    sizes = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rows.withColumn("within", F.row_number().over(order) - 1).join(starts, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("within"))

    # A length's runs lie in one array, so the lookup is a join on the length with at most ``capacity`` rows.
    fields = ("first", "ranks", "sequence", "each", "at")
    by_length: dict[int, list] = {}
    for length, *run in runs:
        by_length.setdefault(length, []).append(tuple(run))
    places = spark.createDataFrame(list(by_length.items()), "length long, runs array<struct<" + ", ".join(f"{f}:long" for f in fields) + ">>")
    run = F.element_at(F.filter("runs", lambda r: (F.col("rank") >= r["first"]) & (F.col("rank") < r["first"] + r["ranks"])), 1)
    placed = ranked.join(F.broadcast(places), "length").withColumn("run", run).withColumn("k", F.col("rank") - F.col("run.first"))
    return placed.withColumn("sequence_id", F.col("run.sequence") + F.floor(F.col("k") / F.col("run.each"))).withColumn(
        "offset", F.col("run.at") + F.pmod(F.col("k"), F.col("run.each")) * F.col("length")
    ).select(*pieces.columns, F.col("sequence_id").cast("long"), F.col("offset").cast("long"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(stored(tokenised_pieces(docs, tokenizer_path, capacity, 0, id_col, text_col), "pieces"), capacity)


def packed_sequences(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences themselves: sequence_id and ids (array of ints, document ends included)."""
    placed = pack_pieces(stored(tokenised_pieces(docs, tokenizer_path, capacity, 0, id_col, text_col, with_ids=True), "pieces"), capacity)
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # at most ``capacity`` pieces
    return parts.select("sequence_id", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"))
