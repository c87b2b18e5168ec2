"""Each operator against a brute-force version, with the awkward inputs every one of them has to take."""

import base64
import collections
import hashlib
import os
import random
import re
import unicodedata
import zlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, fingerprints, jaccard, packing, preference, sharding, suffix_dedup, token_counts, toxicity, warc_zip

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, th string, key int, sig string, id string, n string, spans string, label string, size string, part string, _id int"
LOW = {i: i + 32 for i in range(65, 91)}


def frame(spark, rows, parts=3):
    full = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t), "x", "y", 1, "z", "w", "v", "u", "l", "s", "p", 7) for i, t in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.repartition(parts) if rows else df


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeßé") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    shared, line = prose(rng, 60), prose(rng, 25)
    rows = [(i, prose(rng, rng.randint(30, 160))) for i in range(40)]
    copy = rows[3][1]
    rows += [(100 + i, copy) for i in range(12)]  # copies
    for i in range(12):  # near copies
        words = rows[5][1].split()
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, prose(rng, 40) + " " + shared + " " + prose(rng, 40)) for i in range(10)]
    rows += [(400 + i, "\n".join([line] * 4) + prose(rng, 5)) for i in range(3)]
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "ab"), (504, "a" * 3000), (505, prose(rng, 6000)), (506, "one two three"), (507, "ONE two three")]
    rows += [(3, copy), (600, rows[7][1]), (600, rows[7][1])]  # repeated rows
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return frame(spark, corpus).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# ---------------------------------------------------------------------------- fingerprints


def canonical(t):
    nfkc = lambda s: unicodedata.normalize("NFKC", s)
    return re.sub(r"\s+", " ", nfkc(nfkc(t or "").casefold())).strip(" ")


def test_fingerprints_group_equal_canonical_texts(docs, corpus):
    got = collections.defaultdict(set)
    rows = fingerprints.fingerprint_documents(docs).collect()
    assert len(rows) == len(corpus)
    texts = collections.defaultdict(set)
    for i, t in corpus:
        texts[i].add(canonical(t))
    for r in rows:
        got[r["fingerprint"]].add(next(iter(texts[r["doc_id"]])))
    assert all(len(v) == 1 for v in got.values())
    assert len(got) == len({canonical(t) for _, t in corpus})
    sizes = collections.Counter(canonical(t) for _, t in corpus)
    first = {c: min(i for i, t in corpus if canonical(t) == c) for c in sizes}
    for r in rows:
        c = next(iter(texts[r["doc_id"]]))
        assert (r["group_size"], r["group_id"]) == (sizes[c], first[c])


@pytest.mark.parametrize("a,b", [("Straße", "STRASSE"), ("ﬁne  day", "FINE day "), ("é", "É"), (None, " \t\n")])
def test_canonical_forms_meet(spark, a, b):
    rows = fingerprints.fingerprint_documents(frame(spark, [(1, a), (2, b)])).collect()
    assert len({r["fingerprint"] for r in rows}) == 1


def test_edited_texts(spark, corpus):
    rows = [(i, t) for i, t in dict(corpus).items()]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_report(frame(spark, rows, 5)).collect()}
    order = sorted(rows, reverse=True)
    for n, (i, t) in enumerate(order):
        t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["near_edited"] == float(canonical(t) == canonical(edited))


@pytest.mark.parametrize("ids", [[5, 3, 1, None, None], [None] * 40, [7] * 30 + [9, 2] + [None] * 30, list(range(60))])
def test_rows_are_followed_by_one_another(spark, ids):
    """By descending id, the rows without one last, and the first after the last: one ring of all rows."""
    rows = [(i, f"text {n}") for n, i in enumerate(ids)]
    got = fingerprints.with_successor(frame(spark, rows).select("doc_id", "text"), "doc_id", ["text"]).collect()
    following, own = {r["text"]: r["next_text"] for r in got}, dict((t, i) for i, t in rows)
    assert len(following) == len(rows) and set(following.values()) == set(own)
    seen, at = [], max(own, key=lambda t: (own[t] is not None, own[t] or 0))
    for _ in rows:
        seen.append(at)
        at = following[at]
    assert set(seen) == set(own)
    order = [own[t] for t in seen]
    begin = next(i for i in range(len(order)) if order[i - 1] != order[i] or i == len(order) - 1)
    order = order[begin:] + order[:begin]
    start = next((i for i in range(len(order)) if order[i:] + order[:i] == sorted(ids, key=lambda i: (i is None, -(i or 0)))), None)
    assert start is not None


def test_likeness_to_the_next_text(spark):
    rows = [(9, "Same  text"), (8, "same TEXT"), (7, "other text"), (None, "same text")]
    got = {r["doc_id"]: (r["near_next"], r["near_edited"]) for r in fingerprints.fingerprint_report(frame(spark, rows)).collect()}
    assert {k: v[0] for k, v in got.items()} == {9: 1.0, 8: 0.0, 7: 0.0, None: 1.0}


def test_fingerprints_of_nothing(empty, spark):
    assert fingerprints.fingerprint_report(empty).count() == 0
    assert fingerprints.fingerprint_report(frame(spark, [(1, "a"), (None, "b"), (None, None)])).count() == 3


# ---------------------------------------------------------------------------- suffix arrays


def brute_cut(rows, length):
    count = collections.Counter()
    raw = [(t or "").encode() for _, t in rows]
    for b in raw:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for at in range(len(b) - length + 1):
            if count[b[at : at + length]] > 1:
                gone[at : at + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length,hot", [(200, 8_000), (200, 2), (40, 8_000)])
def test_repeated_strings_are_cut(docs, corpus, monkeypatch, length, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "ANCHOR", 64 if length == 200 else 16)
    got = sorted(tuple(r) for r in suffix_dedup.suffix_report(docs, length).collect())
    assert got == brute_cut(corpus, length)


def test_contexts_with_one_hash_are_told_apart_by_their_bytes(docs, corpus, monkeypatch):
    """All context hashes are made equal: whatever differs must still stay."""
    real = suffix_dedup.segments

    def blunt(*args):
        key, context, *rest = real(*args)
        return key, context * 0, *rest

    monkeypatch.setattr(suffix_dedup, "segments", blunt)
    got = sorted(tuple(r) for r in suffix_dedup.suffix_report(docs).collect())
    assert got == brute_cut(corpus, 200)


def test_strings_sort_by_bytes():
    import numpy as np

    rng = random.Random(3)
    for _ in range(200):
        text = bytes(rng.choice([0, 0, 1, 97, 255]) for _ in range(rng.randint(1, 120)))
        begin = np.array([rng.randrange(len(text)) for _ in range(30)])
        end = np.array([rng.randint(b, len(text)) for b in begin])
        got = suffix_dedup._by_bytes(text, begin, end)
        strings = [text[a:b] for a, b in zip(begin, end)]
        assert sorted(got.tolist()) == list(range(30)) and [strings[i] for i in got] == sorted(strings)


def test_null_ids_and_repeated_rows_count_as_documents(spark):
    rng = random.Random(12)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(None, a), (None, a), (None, b), (1, b[20:] + c), (2, c), (2, c), (2, c), (None, None), (3, prose(rng, 90))]
    got = sorted(tuple(r)[1:] for r in suffix_dedup.suffix_report(frame(spark, rows)).collect())
    assert got == sorted(r[1:] for r in brute_cut([(i or 0, t) for i, t in rows], 200))


def test_texts_without_ids_that_share_half_a_hash_stay_apart(spark):
    """Pairs of texts, short and long, whose 64-bit hashes begin with the same 32 bits: neither is cut as the other is."""
    import xxhash

    rng = random.Random(4)
    base = {n: prose(rng, n) for n in (12, 80, 130)}
    half = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) >> 32
    cases = []
    for short in (12, 130):  # one too short for the other's spans, one longer
        known = {half(t): t for t in (f"{i} {base[short]}" for i in range(250_000))}
        cases.append(next((known[h], t) for t in (f"{base[80]} {i}" for i in range(250_000)) if (h := half(t)) in known))
    for other, long in cases:
        rows = [(None, other), (None, long), (3, "another " + long)]
        assert half(other) == half(long)
        got = sorted(tuple(r)[1:] for r in suffix_dedup.suffix_report(frame(spark, rows)).collect())
        assert got == sorted(r[1:] for r in brute_cut([(i or 0, t) for i, t in rows], 200))
        kept = {(r["doc_id"], r["text"]) for r in suffix_dedup.without_repeats(frame(spark, rows)).collect()}
        assert (None, other) in kept and len(kept) >= 2


def test_many_rows_without_ids_of_one_text_are_dealt_over_tasks(spark, monkeypatch):
    rng = random.Random(6)
    hot, own = prose(rng, 60), prose(rng, 70)
    rows = [(None, hot)] * 3000 + [(1, own + hot), (2, own)]
    df = suffix_dedup._with_spans(frame(spark, rows, 6).select("doc_id", "text"), "doc_id", "text", 200)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = collections.Counter(r[0] for r in df.filter("doc_id is null").selectExpr("spark_partition_id()").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(parts.values()) == 3000 and len(parts) > 1
    got = collections.Counter(tuple(r) for r in suffix_dedup.suffix_report(frame(spark, rows, 6)).collect())
    raw = (own + hot).encode()
    assert got[None, len(hot.encode()), len(hot.encode()), 1, hashlib.sha256(b"").hexdigest()] == 3000
    assert got[1, len(raw), len(raw), 1, hashlib.sha256(b"").hexdigest()] == 1  # own repeats too


def test_suffix_order_and_prefixes():
    rng = random.Random(2)
    for _ in range(60):
        length, letters = rng.choice([3, 5, 9]), rng.choice([b"ab", b"abc", b"abcdefgh"])
        texts = [bytes(rng.choice(letters) for _ in range(rng.randint(length, 40))) for _ in range(rng.randint(1, 8))]
        count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        marks = suffix_dedup.repeated_windows(texts, length)
        assert [m.tolist() for m in marks] == [[count[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] for t in texts]


def test_whole_characters_stay(docs, empty):
    rows = suffix_dedup.without_repeats(docs)
    assert rows.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert 100 not in kept and kept[500] is None and kept[501] == "" and kept[503] == "ab"
    assert suffix_dedup.without_repeats(empty).count() == 0 and suffix_dedup.suffix_report(empty).count() == 0


# ---------------------------------------------------------------------------- packing


def test_packing_places_every_piece(docs, corpus, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, 256).collect()
    want = collections.Counter()
    for i, t in corpus:
        ids = model.encode(t or "", add_special_tokens=False).ids + [0]
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        for p, at in enumerate(range(0, len(ids), 256)):
            part = raw[4 * at : 4 * at + 1024]
            want[(i, p, at, len(part) // 4, zlib.crc32(part))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= 1.02 * -(-total // 256) + 1
    assert packing.pack_documents(empty, path, 256).count() == 0
    whole = packing.packed_sequences(docs, path, 256)
    assert whole.count() == len(sequences)


@pytest.mark.parametrize("text", ["It's 12 o'clock!! we'll see", "ÀÉ ß ŒUVRE ²³ µm", "<|endoftext|> x", "日本語 text", "éa", "a b\x1cc", "İstanbul", "tab\tand\r\nlines"])
def test_words_encode_as_the_library_does(text):
    own = packing.WordTokenizer(P.path("word_bpe_49k.json"))
    ids = own.model.encode(text, add_special_tokens=False).ids
    assert own(text) == b"".join(i.to_bytes(4, "little") for i in ids)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
@pytest.mark.parametrize("file,by_words", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_whole_documents_encode_as_the_library_does(spark, file, by_words):
    own = packing.WordTokenizer(P.path(file))
    assert (own.pattern is not None) == by_words
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        ids = own.model.encode(r["text"] or "", add_special_tokens=False).ids
        assert own(r["text"] or "") == b"".join(i.to_bytes(4, "little") for i in ids)


def test_the_program_packs_what_best_fit_does_not():
    """Lengths 51, 27, 26 and 23 fill sequences of 100 without waste; best fit joins 51 with 27 and cannot."""
    import numpy as np

    for n in (1, 5, 200):
        counts = np.zeros(101, np.int64)
        counts[[51, 27, 26, 23]] = 6 * n, 6 * n, 6 * n, 12 * n
        _, prices, bound = packing.configuration_lp(counts, 100)
        best, _ = packing.knapsack(prices, 100)
        assert (prices * counts).sum() / best[100] == pytest.approx(bound) and bound <= 9 * n + 1e-6
        assert sum(t for _, t in packing.best_fit(counts, 100)) == 11 * n
        assert sum(t for _, t in packing.pack_histogram(counts, 100)) == 9 * n
    halves = np.zeros(101, np.int64)
    halves[51] = 40  # the dual solution moves away from the volumes: no two of these share a sequence
    assert packing.configuration_lp(halves, 100)[2] == pytest.approx(40)


def test_the_program_carries_most_sequences():
    import numpy as np

    rng = np.random.default_rng(3)
    counts = np.bincount(np.clip(rng.lognormal(5.5, 1, 20_000).astype(int), 1, 2048), minlength=2049)
    patterns, prices, bound = packing.configuration_lp(counts, 2048)
    left = counts.copy()
    carried = sum(t for part in packing.rounded(patterns, prices, left, 2048) for _, t in part)
    assert carried >= 0.9 * bound
    total = sum(t for _, t in packing.pack_histogram(counts, 2048))
    assert np.ceil(bound - 1e-6) <= total <= min(sum(t for _, t in packing.best_fit(counts, 2048)), 1.001 * bound + 1)


def test_knapsack_prices_rooms():
    import numpy as np

    rng = np.random.default_rng(7)
    for _ in range(20):
        prices = np.concatenate([[0.0], rng.random(12) * (rng.random(12) < 0.7)])
        best, pick = packing.knapsack(prices, 12)
        want = np.zeros(13)
        for room in range(1, 13):
            want[room] = max([want[room - 1], *(prices[n] + want[room - n] for n in range(1, room + 1))])
        assert np.allclose(best, want)


def test_histogram_packing_uses_every_length_once():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 300):
        counts = np.bincount(rng.integers(1, 65, n), minlength=65)
        packed = packing.pack_histogram(counts, 64)
        assert (sum((p * t for p, t in packed), np.zeros(65, int)) == counts).all()
        assert all((p * np.arange(65)).sum() <= 64 for p, _ in packed)


# ---------------------------------------------------------------------------- toxicity


def test_toxicity_learns_pairs_and_words(spark, empty):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1500):
        words = [prose(rng, 1) for _ in range(20)]
        kind = i % 4  # one word alone is harmless, the pair is not
        if kind in (1, 3):
            words.insert(rng.randrange(20), "blockhead")
        if kind in (2, 3):
            words.insert(rng.randrange(20), "gnomes")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(kind == 3)))
    docs = frame(spark, rows)
    labels = spark.createDataFrame(labels + [(5000, 1, 1), (5001, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score_documents(docs, model).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    right = sum((r["predicted"] == 1) == (r["doc_id"] % 4 == 3) for r in held) / len(held)
    assert right > 0.95
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    odd = frame(spark, [(1, None), (2, ""), (2, ""), (None, "x"), (3, "w " * 30_000)])
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_documents(odd, model).collect())
    assert toxicity.score_documents(empty, model).count() == 0
    none = toxicity.train(docs, labels.filter("false"))
    assert {round(r["score"], 3) for r in toxicity.score_documents(odd, none).collect()} == {0.0}


def test_toxicity_learns_what_no_sum_of_weights_can_say(spark):
    """Exactly one of two words is toxic: neither word differs between the classes, and no additive score separates them."""
    rng = random.Random(9)
    rows = []
    for i in range(6000):
        words = [prose(rng, 1) for _ in range(20)]
        for bit, word in ((1, "blockhead"), (2, "gnomes")):
            if i % 4 & bit:
                words.insert(rng.randrange(20), word)
        rows.append((i, " ".join(words)))
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 4 in (1, 2))) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)

    def right(model):
        held = [r for r in toxicity.score_documents(docs, model).collect() if r["held_out"]]
        return sum((r["predicted"] == 1) == (r["doc_id"] % 4 in (1, 2)) for r in held) / len(held)

    assert right(model) > 0.95
    additive = toxicity.FactorizationMachine(model.slots, model.bias, model.weights, model.factors * 0)
    assert right(additive) < 0.8
    few = toxicity.train(docs, labels, sample=10, most_terms=600)  # the bound holds for terms too
    assert toxicity.score_documents(docs, few).count() == len(rows)


def test_toxicity_sums_all_pairs():
    import numpy as np

    rng = np.random.default_rng(4)
    model = toxicity.FactorizationMachine(np.arange(12), 0.3, rng.normal(size=12), rng.normal(size=(12, 3)))
    texts = [[], [2], [0, 5, 7], list(range(12))]
    text, term = np.array([(i, t) for i, own in enumerate(texts) for t in own]).T
    for own, got in zip(texts, model.raw(term, text, len(texts))):
        want = 0.3 + sum(model.weights[i] for i in own) + sum(float(model.factors[i] @ model.factors[j]) for i in own for j in own if i < j)
        assert got == pytest.approx(want)


def test_toxicity_of_repeated_ids(spark):
    rng = random.Random(2)
    rows = [(1, prose(rng, 5)) for _ in range(50)] + [(i, ("idiot " if i % 2 else "") + prose(rng, 9)) for i in range(2, 400)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 400)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, [*rows, (None, "idiot"), (None, None)])
    got = toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 450 and sum(r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] and r["doc_id"] > 1) > 380


# ---------------------------------------------------------------------------- token counts


def test_token_counts_and_their_cache(spark, docs, corpus, empty, tmp_path):
    from sentencepiece import SentencePieceProcessor

    path = P.path("piece_bpe_32k.model")
    model = SentencePieceProcessor(model_file=path)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):  # the second run finds all counts
        got = collections.Counter(tuple(r) for r in token_counts.count_tokens(docs, path, cache).collect())
        want = collections.Counter()
        for i, t in corpus:
            n = len(model.encode(t or ""))
            want[(i, len((t or "").encode()), n, n > 4096)] += 1
        assert got == want
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("content").distinct().count() == len({t or "" for _, t in corpus})
    assert token_counts.count_tokens(empty, path, cache).count() == 0
    assert token_counts.count_tokens(docs, P.path("byte_bpe_50k.json"), cache).count() == len(corpus)
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


def test_rows_without_ids_and_texts_that_share_one(spark):
    """Counting, packing, sharding and formatting take every row for a document of its own."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    rows = [(None, "alpha beta"), (None, "alpha beta"), (None, None), (None, ""), (7, "one text"), (7, "another, longer text"), (7, "one text")]
    docs = frame(spark, rows)
    model = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = collections.Counter(tuple(r)[:3] for r in token_counts.count_tokens_once(docs, P.path("piece_bpe_32k.model")).collect())
    assert got == collections.Counter((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows)

    words = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = packing.pack_documents(docs, P.path("word_bpe_49k.json"), 4).collect()
    pieces = collections.Counter()
    for i, t in rows:
        n = len(words.encode(t or "", add_special_tokens=False).ids) + 1
        pieces.update((i, at, min(4, n - at)) for at in range(0, n, 4))
    assert collections.Counter((r["doc_id"], r["start"], r["length"]) for r in got) == pieces
    filled = collections.defaultdict(list)
    for r in got:
        filled[r["sequence_id"]] += range(r["offset"], r["offset"] + r["length"])
    assert all(sorted(v) == list(range(len(v))) and len(v) <= 4 for v in filled.values())

    got = sharding.shard_documents(docs, shards=3).collect()
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((i, len((t or "").encode()) + 1) for i, t in rows)
    assert len({r["shard"] for r in got if r["doc_id"] is None and r["size"] == 11}) == 1
    for shard in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))

    turns = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (5, 0, "user", "a"), (5, 1, "assistant", "c"), (3, 0, "user", None), (3, 0, "user", None)]
    got = {r["conv_id"]: r for r in preference.preference_report(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {None, 5, 3}  # turns without an id are one conversation, the last, which is followed by the first
    assert got[None]["rejected_completion"] == "<|assistant|>\nc<|end|>\n" and got[3]["rejected_completion"] == "<|assistant|>\nb<|end|>\n"


@pytest.mark.parametrize("hot", [1, 3, 10_000])
def test_hot_keys_join_like_others(spark, hot):
    from marlstone.llm._common import hot_left_join

    left = spark.createDataFrame([(i, "a" if i < 20 else ("b" if i < 22 else None if i == 22 else "z")) for i in range(30)], "i int, k string")
    right = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    got = sorted((r["i"], r["k"], r["v"]) for r in hot_left_join(left, right, ["k"], "i", hot=hot).collect())
    assert got == sorted((r["i"], r["k"], r["v"]) for r in left.join(right, "k", "left").collect())


# ---------------------------------------------------------------------------- WARC


def test_warc_round_trip(spark, tmp_path):
    html = [(1, "http://a/x y", "<p>é</p>"), (2, None, "same"), (3, "http://b", "same"), (9, "http://c", "same"), (4, "http://d", None), (5, "http://e\r\nX: y", ""), (6, "http://f", "z" * 300_000), (9, "http://c", "same")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in html], "page_id long, url string, html string, payload string, package int").repartition(2)
    packages = warc_zip.write_packages(pages, f"file://{tmp_path}/w", package_bytes=400)
    assert packages.count() > 1
    rows = warc_zip.read_packages(packages).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(r[0] for r in html)
    for r in rows:
        text = next(t or "" for i, _, t in html if i == r["page_id"])
        digest = base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        assert r["payload_digest"] == digest
        keeper = max(i for i, _, t in html if (t or "") == text)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == keeper else ("revisit", keeper))
        assert r["payload"] == (text.encode() if r["record_type"] == "response" else b"")
    full = warc_zip.archive_round_trip(pages, f"file://{tmp_path}/w2").collect()
    assert all(r["payload_bytes"] == len(next(t or "" for i, _, t in html if i == r["page_id"]).encode()) for r in full)
    plain = warc_zip.archive_round_trip(pages, f"file://{tmp_path}/w3", min_bytes=5).collect()
    assert {r["record_type"] for r in plain} == {"response"}
    assert warc_zip.archive_round_trip(pages.filter("false"), f"file://{tmp_path}/w4").count() == 0


def test_pages_that_share_an_id(spark, tmp_path):
    html = [(9, "same"), (9, "a longer page of that id"), (3, "same"), (None, "same"), (None, "alone"), (2, "a longer page of that id"), (None, "twice"), (None, "twice")]
    pages = spark.createDataFrame([(i, f"http://a/{n}", t) for n, (i, t) in enumerate(html)], "page_id long, url string, html string")
    got = warc_zip.archive_round_trip(pages, f"file://{tmp_path}/w").collect()
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = collections.Counter()
    for i, t in html:
        keeper = max((j for j, o in html if o == t and j is not None), default=None)
        want[(i, len(t), digest(t), "response" if i == keeper else "revisit", None if i == keeper else keeper)] += 1
    assert collections.Counter(tuple(r) for r in got) == want


def test_zip64_directories_are_followed(tmp_path):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(66_000):  # more members than the short end record can count
            z.writestr(f"archive/{i}", b"")
        with z.open("archive/last", "w", force_zip64=True) as m:
            m.write(b"payload")
        z.comment = b"PK\x05\x06 in a comment"
    raw = out.getvalue()
    read = lambda at, n: raw[at : at + n]
    members = warc_zip.central_directory(read, len(raw))
    assert len(members) == 66_001
    start = warc_zip.member_start(read, members[-1])
    assert raw[start : start + members[-1].size] == b"payload"
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a", b"x" * 100)
    raw2 = packed.getvalue()
    with pytest.raises(ValueError, match="compressed"):
        warc_zip.member_start(lambda at, n: raw2[at : at + n], warc_zip.central_directory(lambda at, n: raw2[at : at + n], len(raw2))[0])


# ---------------------------------------------------------------------------- sharding


def test_shards_are_even_whole_and_gapless(docs, corpus, empty, spark):
    got = sharding.shard_documents(docs, shards=4).collect()
    assert len(got) == len(corpus)
    slots, sizes, home = collections.defaultdict(list), collections.Counter(), collections.defaultdict(set)
    texts = dict(corpus)
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode()) and r["law"] == "bytes"
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        home[text].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    assert all(len(s) == 1 for s in home.values())  # equal texts share a shard
    by_target = sharding.shard_documents(docs, target_bytes=sum(sizes.values()) // 3 + 1).select("shard").distinct().count()
    assert by_target == 3
    assert sharding.shard_documents(empty).count() == 0
    even = frame(spark, [(i, f"{i:05d}" * 20) for i in range(800)])
    loads = [r["sum(size)"] for r in sharding.shard_documents(even, shards=5).groupBy("shard").sum("size").collect()]
    assert len(loads) == 5 and max(loads) <= 1.05 * min(loads)


# ---------------------------------------------------------------------------- preferences


def test_preferences(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (1, 3, "user", None), (2, 0, "system", "s"), (2, 1, "user", "hi"), (2, 2, "assistant", "no"), (2, 3, "assistant", ""), (3, 0, None, "x")]
    convs = {r["conv_id"]: r["turns"] for r in preference.conversations_of(spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, turns int")).collect()}
    pairs = spark.createDataFrame([(1, convs[1], convs[2]), (2, convs[1], convs[1]), (3, convs[3], []), (4, [], [])], "pair long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r["pair"]: r for r in preference.format_preferences(pairs).collect()}
    r = got[1]
    assert r["prompt"] == "<|system|>\ns<|end|>\n<|user|>\nhi<|end|>\n" and r["prompt_turns"] == 2 and r["usable"]
    at, n = map(int, r["chosen_mask"].split(","[0])[0].split(":"))
    assert r["chosen_completion"][at : at + n] == "yo<|end|>\n"
    spans = [tuple(map(int, s.split(":"))) for s in r["rejected_mask"].split(",")]
    assert [r["rejected_completion"][a : a + n] for a, n in spans] == ["no<|end|>\n", "<|end|>\n"]
    assert got[2]["prompt_turns"] == 4 and got[2]["chosen_completion"] == "" and not got[2]["usable"]
    assert got[3]["prompt"] == "" and got[3]["chosen_completion"] == "<||>\nx<|end|>\n" and not got[4]["usable"]
    assert preference.preference_report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---------------------------------------------------------------------------- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(docs, bench, share=20):
    windows = collections.defaultdict(set)
    for i, t in bench:
        w = WORD.findall((t or "").translate(LOW))
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j : j + n])].add(str(i))
    out = []
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        hit, items = set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
                    items |= windows[tuple(w[j : j + n])]
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(hit) > 0 and share * len(hit) >= len(w)))
    return collections.Counter(out)


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_benchmark_windows_are_found(spark, docs, corpus, empty, block):
    rng = random.Random(8)
    texts = [t for _, t in corpus if t and len(t.split()) > 20]
    bench = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (10, "ab")]
    for i in range(20):
        w = rng.choice(texts).split()
        at, n = rng.randrange(len(w) - 14), rng.choice([9, 12, 13, 14])
        bench.append((20 + i, (prose(rng, 5) if n > 12 else "") + " " + "-".join(w[at : at + n]).upper() + " " + (prose(rng, 5) if n > 12 else "")))
    table = spark.createDataFrame([(*b, "clash") for b in bench], "item_id long, text string, doc_id string")
    got = collections.Counter(tuple(r) for r in decontaminate.contaminated_documents(docs, table, block_bytes=block).collect())
    assert got == brute_hits(corpus, bench)
    clean = decontaminate.without_contaminated(docs, table, block_bytes=block)
    assert clean.columns == docs.columns and clean.count() == sum(n for r, n in got.items() if not r[-1])
    assert decontaminate.contaminated_documents(empty, table).count() == 0
    assert not any(r["n_hit"] for r in decontaminate.contaminated_documents(docs, table.filter("false")).collect())


@pytest.mark.parametrize("block", [8 << 20, 0])
def test_a_window_that_many_items_and_documents_share(spark, monkeypatch, block):
    """Three hundred items and as many documents have one passage; pairs of them are looked at in parts."""
    monkeypatch.setattr(decontaminate, "MATCHES", 500)
    rng = random.Random(14)
    passage, other = prose(rng, 13), prose(rng, 30)
    bench = [(i, prose(rng, 4) + " " + passage + " " + prose(rng, 4)) for i in range(300)] + [(1000, other), (None, prose(rng, 14)), (1001, "two words")]
    rows = [(i, prose(rng, rng.randint(5, 40)) + " " + passage) for i in range(300)]
    rows += [(500, other + " " + other), (501, passage), (501, passage), (None, passage), (None, None), (502, bench[-2][1]), (503, "some two words and two words"), (504, passage.upper() + "! " + other)]
    docs, table = frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.contaminated_documents(docs, table, block_bytes=block, with_spans=True).collect()
    want = brute_hits(rows, [("" if i is None else i, t) for i, t in bench])
    assert collections.Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert sum(s["n"] for s in r["spans"]) == r["n_hit"] and len(r["items"]) == r["n_items"]
        assert all(a["at"] + a["n"] < b["at"] for a, b in zip(r["spans"], r["spans"][1:]))


@pytest.mark.parametrize("bits", [3, 12, 64])
def test_equal_hashes_of_different_windows_are_no_hits(spark, bits):
    """Hashes of 3 bits are equal for most windows and short items; the words decide."""
    rng = random.Random(29)
    vocabulary = ["one", "two", "red", "blue"]
    bench = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 6, 12, 13, 14, 30])))) for i in range(40)] + [(None, prose(rng, 20)), (98, ""), (99, None)]
    rows = [(i, " ".join(rng.choice(vocabulary + ["green"] * 3) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(100 + i, prose(rng, rng.randint(10, 40))) for i in range(60)] + [(None, bench[-3][1]), (300, None), (301, prose(rng, 12)), (302, "x " + bench[6][1].upper() + ", " + bench[-3][1])]
    texts = frame(spark, rows).select(F.coalesce("text", F.lit("")).alias("text")).distinct()
    items = decontaminate._items(spark.createDataFrame(bench, "item_id long, text string"), "item_id", "text")
    want = {t or "": r for (_, t), r in ((row, next(iter(brute_hits([row], [("" if i is None else i, b) for i, b in bench])))) for row in rows) if r[2]}
    hits = decontaminate._hit_texts(texts, items, 13, 20, bits=bits)
    got = texts.select("text", *decontaminate._text_key(F.col("text"))).join(hits, ["h1", "h2"]).collect()
    assert 20 < len(got) < len(rows)
    assert {r["text"]: (r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["contaminated"]) for r in got} == {t: r[2:] for t, r in want.items()}


# ---------------------------------------------------------------------------- Jaccard join


def brute_classes(rows, k=4):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for i, t in rows:
        w = word.findall((t or "").translate(LOW))
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if both and 100 * both >= 85 * (len(x) + len(y) - both):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return collections.Counter((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize("block,send", [(4096, 1_000_000), (4, 0)])
def test_similar_sets_form_classes(docs, corpus, empty, monkeypatch, block, send):
    monkeypatch.setattr(jaccard, "LIST_BLOCK", block)
    monkeypatch.setattr(jaccard, "GROUP", 256 if send else 2)
    monkeypatch.setattr(jaccard, "SHORT", 32 if send else 2)
    monkeypatch.setattr(jaccard, "SENT_MOST", send)
    got = collections.Counter(tuple(r) for r in jaccard.jaccard_classes(docs).collect())
    assert got == brute_classes(corpus)
    if block == 4096:
        kept = jaccard.one_per_class(docs)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted({c for _, _, c in got})
        assert jaccard.jaccard_classes(empty).count() == 0


def test_links_are_not_lost_among_many_near_copies(spark):
    rng = random.Random(4)
    base = prose(rng, 120).split()
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        rows.append((i, " ".join(w[: rng.randint(105, 120)])))
    got = collections.Counter(tuple(r) for r in jaccard.jaccard_classes(frame(spark, rows)).collect())
    assert got == brute_classes(rows)


@pytest.mark.parametrize("group", [256, 1])
def test_null_and_shared_ids_lose_no_links(spark, monkeypatch, group):
    rng = random.Random(8)
    monkeypatch.setattr(jaccard, "GROUP", group)

    def near(text):
        words = text.split()
        words[rng.randrange(len(words))] = prose(rng, 1)
        return " ".join(words)

    a, b, c, d, e = (prose(rng, 90) for _ in range(5))
    # A set that a row without an id holds too; near copies without any id; texts that share an id with others.
    rows = [(None, a), (10, a), (11, near(a)), (None, b), (None, b), (None, near(b)), (20, c), (20, d), (21, near(c)), (22, near(d)), (30, e), (30, prose(rng, 90)), (40, ""), (40, ""), (40, " "), (None, ""), (None, None)]
    docs = frame(spark, rows)
    got = collections.Counter((r[0], r[2]) for r in jaccard.jaccard_classes(docs).collect())
    assert got == collections.Counter([(None, 10), (10, 10), (11, 10)] + 3 * [(None, None)] + [(20, 20), (20, 20), (21, 20), (22, 20), (30, 30), (30, 30)] + 3 * [(40, 40)] + 2 * [(None, None)])
    kept = jaccard.one_per_class(docs)
    assert kept.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    of_b = [t for i, t in kept if i is None and t]
    assert len(of_b) == 1 and of_b[0] in {b, rows[5][1]}
    want = [(10, a), (None, of_b[0]), (20, c), (20, d), (30, e), rows[11], (40, ""), (40, " "), (None, ""), (None, None)]
    assert kept == sorted(want, key=str)


def test_parities_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(50):
        sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for n in (60, 80, 1000, 1100, 2500)]
        rows = [jaccard.parities(s).view(np.uint64) for s in sets]
        bits = jaccard.Bitmaps(np.concatenate(rows), np.cumsum([0, *map(len, rows)]))
        x, y = np.triu_indices(len(sets), 1)
        for i, j, apart in zip(x, y, bits.apart(x, y)):
            assert apart <= len(np.setxor1d(sets[i], sets[j]))
            assert apart > 0 or len(rows[j]) > 2 * len(rows[i])


@pytest.mark.parametrize("block,group,leaders", [(4096, 256, 3), (8, 4, 1)])
def test_links_between_far_copies(spark, monkeypatch, block, group, leaders):
    """Copies of copies: many pairs lie near the bound, and a class holds together by links between its members only."""
    monkeypatch.setattr(jaccard, "LIST_BLOCK", block)
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "LEADERS", leaders)
    rng = random.Random(6)
    rows = []
    for base in (60, 300, 1500):
        texts = [prose(rng, base).split()]
        for i in range(50):
            w = list(rng.choice(texts))
            for _ in range(rng.randint(1, max(2, base // 60))):
                w[rng.randrange(len(w))] = prose(rng, 1)
            texts.append(w)
        rows += [(base * 100 + i, " ".join(w)) for i, w in enumerate(texts)]
    rng.shuffle(rows)
    got = collections.Counter(tuple(r) for r in jaccard.jaccard_classes(frame(spark, rows)).collect())
    assert got == brute_classes(rows)
