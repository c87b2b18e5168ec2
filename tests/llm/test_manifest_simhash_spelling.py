"""Merkle manifest, SimHash classes and spelling variants against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from marlstone.llm import merkle, simhash, spelling

from .test_operators import LOW, SCHEMA, frame, prose


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text): nulls, empties, a very long text, ties of ids, repeated rows, variants of words, near copies."""
    rng = random.Random(11)
    out = [(i, prose(rng, rng.randint(1, 120))) for i in range(60)]
    base = prose(rng, 300)
    out += [(100 + i, base + " " + prose(rng, i % 3)) for i in range(20)]
    out += [(200, None), (201, ""), (202, " \n\t"), (203, "ab"), (204, "a" * 3000), (205, "a" * 2999 + " " + "a" * 3000), (206, "a" * 2999), (207, "A" * 2999 + " " + "a" * 3000), (208, prose(rng, 20000))]
    out += [(3, out[3][1]), (3, out[4][1]), (5, out[5][1]), (5, out[5][1]), (None, None), (None, out[7][1]), (None, out[7][1]), (None, "")]
    out += [(300 + i, " ".join(rng.choice(["colour", "color", "colours", "Colour", "centre", "center", "größe", "grösse", "grosse", "résumé"]) for _ in range(40))) for i in range(30)]
    return out


def plain(rows):
    return sorted(tuple(map(str, r)) for r in rows)


# ---------------------------------------------------------------------------- Merkle manifest


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    for nodes in levels[:-1]:
        begin = i - i % 16
        yield nodes[begin:i], nodes[i + 1 : begin + 16]
        i //= 16


def merkle_by_hand(full):
    by = collections.defaultdict(list)
    for r in full:
        by[r[1]].append((r, leaf(r)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for v in by.values():
        v.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = [levels_of([x for _, x in by[s]]) for s in names]
    top = levels_of([t[-1][0] for t in trees])
    for k, (name, tree) in enumerate(zip(names, trees)):
        for i, (r, own) in enumerate(by[name]):
            path = [*siblings(tree, i), *siblings(top, k)]
            node = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                node = leaf((*r[:4], None if r[4] is None else r[4].translate(LOW)))
            for a, b in path:
                node = sha("".join(a) + node + "".join(b))
            yield r[0], own, tree[-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in path)), node, node == top[-1][0]


FULL = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int, pos int, n int, node string, path string, carried string"


def manifest_frame(spark, full, parts=4):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "y", "z", "c") for r in full], FULL).repartition(parts)


@pytest.mark.parametrize("every", [1, 2, 3])
def test_proofs_by_hand(spark, rows, every):
    sources = ["web", "web", "web", None, "böse", "b", ""]
    full = [(i, sources[(i or 0) % 7], None if (i or 0) % 11 == 0 else "en", None if t is None else len(t), t) for i, t in rows]
    got = merkle.proof_report(manifest_frame(spark, full), every).collect()
    assert plain(got) == plain(merkle_by_hand(full))
    assert {r["verified"] for r in got} == {True, False}


def test_many_sources_and_a_tall_tree(spark):
    full = [(i, f"s{i}" if i % 4 == 0 else "hot", "en", 1, "A") for i in range(1400)]  # 350 lone leaves, one tree of three levels
    assert plain(merkle.proof_report(manifest_frame(spark, full)).collect()) == plain(merkle_by_hand(full))


def test_one_row_is_its_own_root_and_no_rows_have_none(spark):
    one = merkle.proof_report(manifest_frame(spark, [(1, None, None, None, "t")], 1)).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] == leaf((1, None, None, None, "t")) and one["proof_sha256"] == sha("")
    none = merkle.build_manifest(manifest_frame(spark, []))
    assert none.root.count() == 0 and none.proofs().count() == 0


def test_copies_without_ids_are_dealt_over_ranges(spark):
    full = [(None, "hot", "en", 1, "same")] * 3000 + [(i, "other", "en", 1, str(i)) for i in range(300)]
    df = manifest_frame(spark, full, 8)
    assert plain(merkle.proof_report(df).collect()) == plain(merkle_by_hand(full))
    leaves = df.select("source", df.doc_id.alias("id"), merkle.leaf_digest("source", "text").alias("node"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would become one range
    try:
        placed, _ = merkle._numbered(leaves, ["source"], ["id", "node"], "test")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert placed.filter("source = 'hot'").select("_range").distinct().count() > 1


def test_a_proof_tells_a_change_of_any_field(spark):
    full = [(i, "s", "en", 5, f"text {i}") for i in range(40)]
    m = merkle.build_manifest(manifest_frame(spark, full))
    root, proofs = m.root.first()["root"], {r["leaf"]: r["path"] for r in m.proofs().collect()}
    fold = lambda node, path: node if not path else fold(sha(path[0]["l"] + node + path[0]["r"]), path[1:])
    for r in full[:5]:
        assert fold(leaf(r), proofs[leaf(r)]) == root
        assert fold(leaf((*r[:3], 6, r[4])), proofs[leaf(r)]) != root


# ---------------------------------------------------------------------------- SimHash


def simhash_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(points, distance):
    points = sorted(points)
    label = {p: p for p in points}
    changed = True
    while changed:
        changed = False
        for i, p in enumerate(points):
            for q in points[i + 1 :]:
                if (p ^ q).bit_count() <= distance and label[p] != label[q]:
                    label[p] = label[q] = min(label[p], label[q])
                    changed = True
    return label


def test_simhash_by_hand(spark, rows, monkeypatch):
    monkeypatch.setattr(simhash, "RUN", 1000)
    got = simhash.simhash_classes(frame(spark, rows)).collect()
    prints = [simhash_by_hand(t) for _, t in rows]
    label, least = components(set(prints), 4), {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], i))
    assert plain(got) == plain((i, f"{p:016x}", least.get(label[p])) for (i, _), p in zip(rows, prints))
    assert len(set(label.values())) < len(set(prints))


def clusters(rng):
    """Fingerprints in chains and balls, near each other in either half, and alone."""
    points = {rng.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(25):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 6)):
                q ^= 1 << b
            points.add(q)
            p = q if rng.random() < 0.5 else p
    return points


@pytest.mark.parametrize("distance", [0, 1, 3, 4, 5])
@pytest.mark.parametrize("cell", [20_000, 3])
def test_grid_join_loses_no_class(spark, monkeypatch, distance, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    points = clusters(random.Random(distance))
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "bits long"), distance).collect()
    pairs = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in links]
    assert all((a ^ b).bit_count() <= distance for a, b in pairs)
    found = {p: p for p in points}
    for _ in range(len(points)):
        before = dict(found)
        for a, b in pairs:
            found[a] = found[b] = min(found[a], found[b])
        if found == before:
            break
    assert found == components(points, distance)


def test_a_dense_cell_gives_a_forest():
    rng = np.random.default_rng(2)
    points = np.unique(np.uint64(1) << rng.integers(0, 64, 3000, np.uint64) | np.uint64(1) << rng.integers(0, 64, 3000, np.uint64))
    a, b = simhash.forest(points, 4)
    assert len(a) == len(points) - 1 and len(np.unique(b)) == len(b)  # all are within four bits of each other


def test_simhash_of_hot_copies_and_of_nothing(spark):
    rows = [(None, "one two three four five")] * 3000 + [(7, "ONE two three four five"), (9, None), (8, "")]
    got = collections.Counter(simhash.simhash_classes(frame(spark, rows)).collect())
    one = f"{simhash_by_hand(rows[0][1]):016x}"
    assert got == {(None, one, 7): 3000, (7, one, 7): 1, (9, "0" * 16, 8): 1, (8, "0" * 16, 8): 1}
    assert simhash.simhash_classes(frame(spark, [])).collect() == []
    assert simhash.simhash_classes(frame(spark, [(None, "a b c")])).collect()[0]["component_id"] is None


# ---------------------------------------------------------------------------- spelling


def counts_by_hand(rows):
    found = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            found[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def near_by_hand(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(n):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and near_by_hand(w, v)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) if v else None for w, v in near.items()}
    form = {w: f if f is not None and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return [(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n]


@pytest.mark.parametrize("part", [4_000, 5])
def test_variants_by_hand(spark, rows, monkeypatch, part):
    monkeypatch.setattr(spelling, "PART", part)
    monkeypatch.setattr(spelling, "HELD", 50)
    got = spelling.spelling_variants(frame(spark, rows)).collect()
    want = variants_by_hand(counts_by_hand(rows))
    assert plain(got) == plain(want)
    forms = {r["word"]: r["form"] for r in got}
    assert {"a" * 2999, "a" * 3000, "colour", "größe"} <= set(forms) and any(forms.values())


def test_pairs_of_words_at_the_ends(spark):
    words = ["abcde", "xbcde", "bcde", "abcd", "abcdef", "zabcde", "abxcde", "aaaaa", "aaaaaa", "aaaa", "fghij", "fghji"]
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = sorted(tuple(sorted((r["word"], r["near"]))) for r in spelling.near_words(df, 5, pairs=True).collect())
    long = [w for w in words if len(w) >= 5]
    assert got == sorted(tuple(sorted((a, b))) for i, a in enumerate(long) for b in long[i + 1 :] if near_by_hand(a, b))
    got = sorted(tuple(sorted((r["word"], r["near"]))) for r in spelling.near_words(df, 1, pairs=True).collect())
    assert got == sorted(tuple(sorted((a, b))) for i, a in enumerate(words) for b in words[i + 1 :] if near_by_hand(a, b))


def test_forms_go_by_count_then_code_points_and_roots_follow_them(spark):
    text = " ".join(["house"] * 3 + ["mouse"] * 8 + ["louse"] * 8 + ["loose"] * 40 + ["hoise"] * 5)
    got = {r["word"]: r for r in spelling.spelling_variants(frame(spark, [(1, text)]), every=10**9).collect()}
    assert got["house"]["form"] == "louse" and got["house"]["n_near"] == 3 and got["house"]["root"] == "loose"
    assert got["mouse"]["form"] is None and got["mouse"]["form_n"] is None and got["mouse"]["root"] == "mouse"
    assert got["hoise"]["form"] is None and got["hoise"]["n_near"] == 1


def test_no_words(spark):
    assert spelling.spelling_variants(frame(spark, [])).collect() == []
    assert spelling.spelling_variants(frame(spark, [(1, None), (2, ""), (None, "1 2 3 four")])).collect() == []
    assert "word" in spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).columns


# ---------------------------------------------------------------------------- many rows without ids


def test_copies_without_ids_are_dealt_over_tasks(spark, tmp_path):
    """Salts follow where a row was read, as an id that all lack would give one salt."""
    import public_tokenizers

    from marlstone.llm import fingerprints, jaccard, token_counts

    docs = frame(spark, [(None, "one hot text of some words")] * 3000 + [(i, f"{i} cold") for i in range(20)], 6)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for made in (
            fingerprints.fingerprint_documents(docs),
            token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), f"file://{tmp_path}/cache"),
            jaccard.jaccard_classes(docs),
            simhash.simhash_classes(docs),
        ):
            parts = collections.Counter(r[0] for r in made.filter("doc_id is null").selectExpr("spark_partition_id()").collect())
            assert sum(parts.values()) == 3000 and len(parts) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
