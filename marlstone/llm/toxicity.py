"""Toxicity by a factorization machine over hashed terms.

A document's terms are its different words (A-Z lower-cased) and their beginnings of four to six bytes,
hashed to 2^20 slots. The machine adds a weight for every term and, for every pair, the inner product
of two short vectors, so that pairs of terms count that are harmless alone. Terms are kept for telling the
classes apart, or, of the most frequent of the others, for being in a pair that does. It is trained on a bounded sample of labelled rows: the least by hash of the id, ``sample`` a class and
``most_terms`` different terms in all documents together, 4 bytes each (the driver gets no more). Classes are
weighted half way between their shares and balance. All documents are scored, whole.

Empty and null texts get the score of a text without terms. Rows without a label train nothing; without
both labels the score is the share of label 1 (0 without labels). Repeated rows are scored alike; of several
labels of an id the largest counts, and of several texts the first in order. Null ids are never learnt from and
scored like others. Extra columns are ignored; an empty table gives no rows. Neither labels nor ids, languages
or sources are inputs of a score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import forget, give_back, lean, stored
from ._hashing import LOWER, Powers, Rolling, byte_class, in_chunks, text_buffers

SLOT_BITS = 20
IS_WORD = byte_class(outside=bytes([*range(0x00, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
STARTS = (4, 5, 6)


def terms_of(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(slot, text number) of every term occurrence of a chunk."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = LOWER[data]
    inside = IS_WORD[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (np.append(True, ~inside[:-1]) | edge[:n]))
    ends = np.flatnonzero(inside & (np.append(~inside[1:], True) | edge[1:])) + 1
    rolling = Rolling(low, powers)
    text = np.searchsorted(offsets, starts, "right") - 1
    slots, texts = [rolling.spans(starts, ends)], [text]
    for k in STARTS:
        long = ends - starts > k
        slots.append(rolling.spans(starts[long], starts[long] + k) ^ np.uint64(0x5851F42D4C957F2D * k & (1 << 64) - 1))
        texts.append(text[long])
    return (np.concatenate(slots) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), np.concatenate(texts)


class FactorizationMachine:
    """Logistic, of degree two, over binary terms."""

    def __init__(self, slots: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.slots, self.bias, self.weights, self.factors = slots, bias, weights, factors

    def lookup(self) -> np.ndarray:
        table = np.full(1 << SLOT_BITS, -1, np.int32)
        table[self.slots] = np.arange(len(self.slots), dtype=np.int32)
        return table

    def raw(self, term: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """Scores before the logistic function of ``texts`` texts, from their different (term, text) pairs."""
        total = self.bias + np.bincount(text, self.weights[term], minlength=texts)
        for f in self.factors.T:
            total += 0.5 * (np.bincount(text, f[term], minlength=texts) ** 2 - np.bincount(text, f[term] ** 2, minlength=texts))
        return total

    @staticmethod
    def constant(share: float) -> FactorizationMachine:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return FactorizationMachine(np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, 1)))

    @staticmethod
    def fit(slots: np.ndarray, term: np.ndarray, begin: np.ndarray, label: np.ndarray, row_weight: np.ndarray, rank: int = 4, epochs: int = 20, batch: int = 128, rate: float = 0.1, decay: float = 2e-4, seed: int = 13) -> FactorizationMachine:
        """Text i has label[i] and the different terms term[begin[i]:begin[i + 1]], which are places in ``slots``. Steps are AdaGrad's."""
        share = float((label * row_weight).sum() / row_weight.sum())
        if not 0 < share < 1:
            return FactorizationMachine.constant(share)
        rng, n = np.random.default_rng(seed), len(slots)
        w, v, bias = np.zeros(n), rng.normal(0, 0.02, (rank, n)), float(np.log(share / (1 - share)))
        gw, gv, gb = np.full(n, 1e-2), np.full((rank, n), 1e-2), 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(label))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                count = begin[some + 1] - begin[some]
                t = np.repeat(np.arange(len(some)), count)
                used, inverse = np.unique(np.concatenate([term[begin[i] : begin[i + 1]] for i in some]), return_inverse=True)
                own = v[:, used]
                sums = np.stack([np.bincount(t, f[inverse], minlength=len(some)) for f in own])
                squares = np.bincount(t, (own**2).sum(axis=0)[inverse], minlength=len(some))
                out = bias + np.bincount(t, w[used][inverse], minlength=len(some)) + 0.5 * ((sums**2).sum(axis=0) - squares)
                miss = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - label[some]) * row_weight[some] / len(some)
                each = np.bincount(inverse, miss[t], minlength=len(used))
                dw = each + decay * w[used]
                dv = np.stack([np.bincount(inverse, (miss * f)[t], minlength=len(used)) for f in sums]) - own * each + decay * own
                gw[used] += dw**2
                gv[:, used] += dv**2
                gb += miss.sum() ** 2
                w[used] -= rate * dw / np.sqrt(gw[used])
                v[:, used] -= 0.3 * rate * dv / np.sqrt(gv[:, used])
                bias -= rate * miss.sum() / np.sqrt(gb)
        return FactorizationMachine(slots, bias, w, v.T)


def _apart(in0: np.ndarray, in1: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Standard errors by which shares of two classes differ."""
    p = np.clip((in1 + in0) / (n1 + n0), 1e-9, 1 - 1e-9)
    return np.abs(in1 / n1 - in0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))


def telling_terms(in0: np.ndarray, in1: np.ndarray, n0: int, n1: int, least: float = 2.0) -> np.ndarray:
    """Which slots' shares in the two classes differ by ``least`` standard errors; of those in three texts at least."""
    return (in0 + in1 >= 3) & (_apart(in0, in1, n0, n1) > least)


def telling_pairs(term: np.ndarray, begin: np.ndarray, label: np.ndarray, terms: int, least: float = 6.0, above: float = 2.0) -> np.ndarray:
    """Which terms are in a pair whose joint presence differs between the classes by ``least`` standard errors and by ``above`` more than either of it alone.

    Text i holds the different terms term[begin[i]:begin[i + 1]] (numbers below ``terms``; others are passed over).
    """
    both = np.zeros((2, terms, terms), np.float32)
    for value in (0, 1):
        rows = np.flatnonzero(label == value)
        for at in range(0, len(rows), 512):
            part = rows[at : at + 512]
            held = np.zeros((len(part), terms), np.float32)
            for i, row in enumerate(part):
                own = term[begin[row] : begin[row + 1]]
                held[i, own[own < terms]] = 1
            both[value] += held.T @ held
    n0, n1 = int((label == 0).sum()), int((label == 1).sum())
    found = np.zeros(terms, bool)
    alone = _apart(np.diagonal(both[0]), np.diagonal(both[1]), n0, n1)
    for a in range(terms):
        z = _apart(both[0, a], both[1, a], n0, n1)
        pairs = (z > least) & (z > np.maximum(alone, alone[a]) + above) & (both[0, a] + both[1, a] >= 3)
        found |= pairs
        found[a] |= pairs.any()
    return found


def held_out(id_col: str, folds: int = 5) -> Column:
    """Ids whose labels are never learnt: crc32 of the id as text is divisible by ``folds``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000, most_terms: int = 16_000_000, screened: int = 2048, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FactorizationMachine:
    """Learns from at most ``sample`` documents of each label with ``most_terms`` terms in all; ``screened`` terms that tell nothing alone are judged in pairs."""
    label = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    label = label.filter(~held_out("_id"))
    shares = {r["_label"]: r["count"] for r in label.groupBy("_label").count().collect()}
    if len(shares) < 2:
        return FactorizationMachine.constant(float(max(shares, default=0)))
    chosen = None
    for value in (0, 1):
        part = label.filter(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)

    @lean
    def slots(batches):
        import pyarrow as pa

        powers = Powers()
        for batch in batches:
            found: list[bytes] = []
            for _, data, offsets in in_chunks(*text_buffers(batch.column(0))):
                slot, text = terms_of(data, offsets, powers)
                pairs = np.unique(text * (1 << SLOT_BITS) + slot)
                cut = np.searchsorted(pairs >> SLOT_BITS, np.arange(len(offsets)))
                own = (pairs & ((1 << SLOT_BITS) - 1)).astype("<i4")
                found += [own[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
            sizes = np.array([len(f) // 4 for f in found], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.binary()), pa.array(sizes)], names=["label", "place", "slots", "n"])

    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    picked = texts.join(F.broadcast(chosen), "_id")  # 2 * sample rows at most
    picked = picked.groupBy("_id", "_label").agg(F.min("text").alias("text")).select("text", "_label", F.xxhash64("_id").alias("place"))
    rows = stored(picked.mapInArrow(slots, "label int, place long, slots binary, n long"), "toxicity-terms")
    sizes = rows.select("place", "n", "label").toArrow()  # three numbers a sampled row
    place, n, y = (sizes.column(i).to_numpy() for i in range(3))
    order = np.argsort(place, kind="stable")
    learnt = order[np.cumsum(n[order]) <= most_terms]
    n1 = int(y[learnt].sum())
    n0 = len(learnt) - n1
    if not n0 or not n1:
        forget(rows)
        return FactorizationMachine.constant(shares.get(1, 0) / sum(shares.values()))
    rows = rows.filter(F.col("place") <= int(place[learnt[-1]]))

    @lean
    def counts(batches):
        import pyarrow as pa

        total = np.zeros((2, 1 << SLOT_BITS), np.int32)
        for batch in batches:
            for y, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[y][np.frombuffer(own.as_buffer(), "<i4")] += 1
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[0][some]), pa.array(total[1][some])], names=["slot", "in0", "in1"])

    total = rows.select("label", "slots").mapInArrow(counts, "slot int, in0 int, in1 int").groupBy("slot").agg(F.sum("in0").cast("int"), F.sum("in1").cast("int")).toArrow()
    in_class = np.zeros((2, 1 << SLOT_BITS), np.int32)  # a counter a slot
    for i in (0, 1):
        in_class[i][total.column(0).to_numpy()] = total.column(i + 1).to_numpy()
    told = telling_terms(in_class[0], in_class[1], n0, n1)
    # The most frequent of the other terms come first in number, to be judged in pairs.
    rest = np.where(told, -1, in_class.sum(axis=0))
    frequent = np.argsort(-rest, kind="stable")[:screened]
    frequent = frequent[rest[frequent] >= 3]
    kept = np.concatenate([frequent, np.flatnonzero(told)])
    lookup = np.full(1 << SLOT_BITS, -1, np.int32)
    lookup[kept] = np.arange(len(kept), dtype=np.int32)
    sent = docs.sparkSession.sparkContext.broadcast(lookup)  # 4 MB

    def known(batches):
        import pyarrow as pa

        for batch in batches:
            found = [sent.value[np.frombuffer(s.as_buffer(), "<i4")] for s in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[f >= 0].tobytes() for f in found], pa.binary())], names=["label", "place", "terms"])

    got = rows.select("label", "place", "slots").mapInArrow(known, "label int, place long, terms binary").toArrow()  # 4 * most_terms bytes at most
    order = np.argsort(got.column(1).to_numpy(), kind="stable").tolist()
    y = got.column(0).to_numpy()[order].astype(float)
    texts_terms = got.column(2)
    begin = np.cumsum([0, *(len(texts_terms[i].as_buffer()) // 4 for i in order)])
    term = np.empty(begin[-1], np.int32)
    for at, i in enumerate(order):
        term[begin[at] : begin[at + 1]] = np.frombuffer(texts_terms[i].as_buffer(), "<i4")
    del got, texts_terms
    sent.unpersist()
    forget(rows)
    paired = telling_pairs(term, begin, y, len(frequent))
    use = np.concatenate([paired, np.ones(len(kept) - len(frequent), bool)])
    number, used = (np.cumsum(use) - 1).astype(np.int32), use[term]
    begin = np.concatenate([np.zeros(1, np.int32), np.cumsum(used, dtype=np.int32)])[begin]  # numbers up to ``most_terms``
    term = number[term[used]]
    del used
    # Back to the labels' shares, half way to balance: the rarer label counts by the root of the ratio.
    weight = np.where(y == 1, shares[1] / n1 * np.sqrt(shares[0] / shares[1]), shares[0] / n0)
    give_back()
    model = FactorizationMachine.fit(kept[use], term, begin, y, weight / weight.mean())
    del term, begin
    give_back()  # the driver goes on to other stages
    return model


def _scorer(model: FactorizationMachine):
    """A function from an Arrow text column to scores."""
    state: dict = {}

    def score(column) -> np.ndarray:
        if not state:
            state.update(table=model.lookup(), powers=Powers())
        out = np.zeros(len(column))
        for row, data, offsets in in_chunks(*text_buffers(column)):
            slot, text = terms_of(data, offsets, state["powers"])
            term = state["table"][slot]
            pairs = np.unique(text[term >= 0] * (1 << SLOT_BITS) + term[term >= 0])
            n = len(offsets) - 1
            raw = model.raw(pairs & ((1 << SLOT_BITS) - 1), pairs >> SLOT_BITS, n)
            out[row : row + n] = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return out

    return score


def score_documents(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted."""
    scorer = _scorer(model)

    @lean
    def scores(batches):
        import pyarrow as pa

        for batch in batches:
            s = scorer(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(scores, f"{id_col} {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``."""
    scorer = _scorer(model)
    at = docs.columns.index(text_col)

    @lean
    def keep(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            yield batch.filter(pa.array(scorer(pc.fill_null(batch.column(at), "")) < threshold))

    return docs.mapInArrow(keep, docs.schema)
