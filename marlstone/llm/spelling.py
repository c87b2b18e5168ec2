"""Spelling variants: the vocabulary's acceptor composed with a one-edit transducer and with the acceptor again.

A word is a run of letters of at least ``least_length`` code points that occurs at least ``least_count`` times. Two words are near
that differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of largest count (ties: the
smallest in code-point order), if that is ``ratio`` times its own or more; its root is what following forms leads to.

1. Counting. Every task counts its words and hands sums on, so a frequent word travels once a task.
2. Initial states. Of two near words, of which the shorter has L code points, the first half of L code points or the last other half
   is equal. A word therefore goes to the states reached by its first half and, read backwards, by its last half, for its own
   length and for the length below. All words of one such state are the partition that is composed on its own.
3. Composition. The words of a partition become a minimised acyclic acceptor (sorted words, equal suffix states merged). The
   composed machine's states are (state left, edit used or not, state right); from the initial state both sides read equal letters, one edit arc
   leads to the states where nothing may differ any more. Pairs of states are entered only if their
   remaining words meet, which is kept for each pair. Accepted pairs give, a word, the number of near words and the best one, so pairs do not travel.
   Backwards, pairs that share the first half are left to the other partition: each pair is accepted once.
4. Roots. Forms have at least ``ratio`` times the count, so chains are short; they are followed by doubling.

A partition of over ``PART`` words is dealt to pairs of parts: acceptors of two parts are composed, so no partition fills a task. Null texts
have no words, a null id is written as nothing before the colon, repeated rows count as often as they stand there, texts without words
add nothing, an empty table gives no rows, extra columns are ignored. Very long texts are read as a stream of runs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import forget, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {i: i + 32 for i in range(65, 91)}
HELD = 200_000  # different words that a task holds before it hands them on
PART = 4_000  # words of a partition that are composed at once


def altered(prefix: int, word: str, every: int) -> str:
    """The word, or the word without one code point where its checksum after the document's (``prefix``) says so."""
    h = zlib.crc32(word.encode(), prefix)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, every: int = 97, least_length: int = 5, least_count: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of every word with at least ``least_count`` occurrences; every ``every``-th run of a document, by checksum, lacks a code point."""

    def count(batches):
        import pyarrow as pa

        found: Counter = Counter()

        def ready():
            batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return batch

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                prefix = zlib.crc32(f"{'' if i is None else i}:".encode())
                runs = (m.group() for m in RUN.finditer(text.as_py()))
                while part := Counter(islice(runs, HELD)):
                    for run, n in part.items():
                        low = run.lower() if run.isascii() else run.translate(LOWER)
                        if len(word := altered(prefix, low, every)) >= least_length:
                            found[word] += n
                    if len(found) > HELD:
                        yield ready()
        if found:
            yield ready()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# ---------------------------------------------------------------------------- acceptors


class Acceptor:
    """The minimised acyclic acceptor of sorted words; several acceptors of one ``table`` share their equal states.

    A state is a number; ``arcs`` lists its letters and followers, ``final`` whether a word ends there.
    """

    def __init__(self, table: StateTable, words: list[str]):
        self.table = table
        path: list[list] = [[False, []]]  # unfinished states of the last word: whether final, arcs
        last = ""
        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            self._close(path, last, same)
            path += [[False, []] for _ in range(len(word) - same)]
            path[-1][0] = True
            last = word
        self._close(path, last, 0)
        self.start = table.state(*path[0])

    def _close(self, path: list[list], last: str, depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], self.table.state(final, arcs)))


class StateTable:
    """Equal states have one number: whether final, and the same letters to the same followers."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.final: list[bool] = []
        self.arcs: list[tuple] = []
        self.meet: dict[tuple[int, int], bool] = {}

    def state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in self.known:
            self.known[key] = len(self.final)
            self.final.append(final)
            self.arcs.append(key[1])
        return self.known[key]

    def shared(self, p: int, q: int) -> list[tuple[str, int, int]]:
        """The arcs that both states have: letter and the two followers."""
        if p == q:
            return [(a, f, f) for a, f in self.arcs[p]]
        other = dict(self.arcs[q])
        return [(a, f, other[a]) for a, f in self.arcs[p] if a in other]

    def meets(self, p: int, q: int) -> bool:
        """Whether some word is accepted from both states; asked once for each pair of states, without recursion as words may be long."""
        todo = [(p, q)]
        while todo:
            p, q = pair = todo[-1]
            if pair in self.meet:
                todo.pop()
            elif p == q or (self.final[p] and self.final[q]):
                self.meet[pair] = True
            else:
                followers = [(f, g) for _, f, g in self.shared(p, q)]
                if any(self.meet.get(f) for f in followers):
                    self.meet[pair] = True
                elif missing := [f for f in followers if f not in self.meet]:
                    todo.append(missing[0])
                else:
                    self.meet[pair] = False
        return self.meet[pair]

    def common(self, p: int, q: int) -> Iterator[str]:
        """The words accepted from both states: what the composed machine reads after its edit."""
        if not self.meets(p, q):
            return
        read: list[str] = []
        todo = [(0, "", p, q)]
        while todo:
            depth, letter, p, q = todo.pop()
            read[depth - 1 :] = [letter] if depth else []
            if self.final[p] and self.final[q]:
                yield "".join(read)
            todo += [(depth + 1, a, f, g) for a, f, g in self.shared(p, q) if self.meets(f, g)]


def near_pairs(table: StateTable, left: int, right: int, same: bool) -> Iterator[tuple[str, str]]:
    """Pairs (x, y) of words accepted from ``left`` and ``right`` that one edit turns into each other; ``same``: one acceptor, each pair once."""
    read: list[str] = []
    todo = [(0, "", left, right)]
    while todo:
        depth, letter, p, q = todo.pop()
        read[depth - 1 :] = [letter] if depth else []
        begin = None
        for a, follower, b, also in _edits(table, p, q, same):
            for w in table.common(follower, also):
                # In a run of equal letters any may be the missing one: the last of them is taken.
                if (a and b) or not w.startswith(a or b):
                    begin = "".join(read) if begin is None else begin
                    yield begin + a + w, begin + b + w
        todo += [(depth + 1, a, f, g) for a, f, g in table.shared(p, q)]


def _edits(table: StateTable, p: int, q: int, same: bool) -> Iterator[tuple[str, int, str, int]]:
    """The transducer's edit arcs from a pair of states: letter (or none) and follower on either side."""
    for a, follower in table.arcs[p]:
        yield a, follower, "", q
        for b, also in table.arcs[q]:
            if a < b or (a > b and not same):
                yield a, follower, b, also
    if not same:
        for b, also in table.arcs[q]:
            yield "", p, b, also


# ---------------------------------------------------------------------------- the operator


def _partitions(words: DataFrame, least_length: int) -> DataFrame:
    """Rows (least, back, half, p, q, side, word, n): every word in the partitions of its initial states. side 0: in both acceptors, 1: left, 2: right."""
    size = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.filter(F.array(size, size - 1), lambda s: s >= least_length)).alias("least"))
    first = F.floor(F.col("least") / 2).cast("int")
    halves = F.array(
        F.struct(F.lit(False).alias("back"), F.substring("word", F.lit(1), first).alias("half")),
        F.struct(F.lit(True).alias("back"), F.substring("word", first - F.col("least"), F.col("least") - first).alias("half")),
    )
    rows = rows.select("word", "n", "least", F.inline(halves))
    sizes = rows.groupBy("least", "back", "half").count().filter("count > 1")
    sizes = sizes.select("least", "back", "half", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    rows = rows.join(sizes, ["least", "back", "half"])  # a word alone has nobody to meet
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(own, i).alias("p"), F.greatest(own, i).alias("q"), F.when(own < i, 1).when(own > i, 2).otherwise(0).alias("side")))
    return rows.select("least", "back", "half", "word", "n", F.inline(cells))


def _accepted(least: int, back: bool, one: list[str], two: list[str] | None) -> Iterator[tuple[str, str]]:
    """Near pairs of a partition whose shorter word has ``least`` code points; ``two``: words of another part, or None for pairs within ``one``."""
    skip, table = least // 2, StateTable()
    read = (lambda w: w[::-1]) if back else (lambda w: w)
    left = Acceptor(table, sorted(map(read, one))).start
    right = left if two is None else Acceptor(table, sorted(map(read, two))).start
    for x, y in near_pairs(table, left, right, two is None):
        if min(len(x), len(y)) == least and not (back and x[len(x) - skip :] == y[len(y) - skip :]):
            yield read(x), read(y)


def near_words(words: DataFrame, least_length: int = 5, pairs: bool = False) -> DataFrame:
    """(word, n_near, form_n, form): how many of ``words`` (word, n) are near each word, and the best of them; words without any are left out.

    With ``pairs``, (word, near) of all near pairs instead, each once.
    """

    def enumerate_pairs(batches):
        import pyarrow as pa

        groups: tuple | None = None
        sides: tuple[dict, dict, dict] = ({}, {}, {})
        best: dict[str, list] = {}
        listed: list[tuple[str, str]] = []

        def close():
            both, left, right = sides
            if both:
                found = _accepted(groups[0], groups[1], list(both), None)
            else:
                found = _accepted(groups[0], groups[1], list(left), list(right)) if left and right else ()
            counts = both | left | right
            for x, y in found:
                if pairs:
                    listed.append((x, y))
                    continue
                for a, b in ((x, y), (y, x)):
                    rank = (-counts[b], b)
                    known = best.get(a)
                    if known is None:
                        best[a] = [1, rank]
                    else:
                        known[0] += 1
                        known[1] = min(known[1], rank)
            for side in sides:
                side.clear()

        def ready():
            if pairs:
                batch = pa.RecordBatch.from_arrays([pa.array([p[i] for p in listed], pa.string()) for i in (0, 1)], names=["word", "near"])
            else:
                columns = [list(best), [v[0] for v in best.values()], [-v[1][0] for v in best.values()], [v[1][1] for v in best.values()]]
                batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "form_n", "form"])
            best.clear()
            listed.clear()
            return batch

        for batch in batches:
            for *key, side, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (key := tuple(key)) != groups:
                    if groups is not None:
                        close()
                    if len(best) + len(listed) > HELD:
                        yield ready()
                    groups = key
                sides[side][word] = n
        if groups is not None:
            close()
        yield ready()

    keys = ["least", "back", "half", "p", "q"]
    dealt = _partitions(words, least_length).select(*keys, "side", "word", "n").repartition(*map(F.col, keys)).sortWithinPartitions(*keys)
    if pairs:
        return dealt.mapInArrow(enumerate_pairs, "word string, near string")
    rows = dealt.mapInArrow(enumerate_pairs, "word string, n_near long, form_n long, form string")
    return rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("m")).select("word", "n_near", (-F.col("m.less")).alias("form_n"), "m.form")


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), form null at the end of a chain: what following forms leads to, by doubling; each round is a table."""
    step = stored(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        further = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(step.join(further, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        moved = after.filter("moved").limit(1).count()
        forget(step)
        step = after.select("word", "root")
        if not moved:
            return step


def spelling_variants(docs: DataFrame, every: int = 97, least_length: int = 5, least_count: int = 3, ratio: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs``."""
    words = stored(word_counts(docs, every, least_length, least_count, id_col, text_col), "words")
    near = near_words(words, least_length)
    rows = words.join(near, "word", "left")
    good = F.col("form_n") >= ratio * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"))
    rows = stored(rows, "forms")
    forget(words)
    return rows.join(roots_of(rows), "word").select("word", "form", "root", "n", "n_near", "form_n")
