"""The stages of the pipeline against brute force, on a small table."""

import collections
import random

import corpus_pipeline
from tests.llm.test_operators import brute_classes, brute_cut, brute_hits, prose


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    bench = [(i, prose(rng, 20)) for i in range(3)]
    passage = prose(rng, 70)
    rows = [(i, prose(rng, rng.randint(40, 120)) + (" idiot scum" if i % 5 == 0 else "")) for i in range(400)]
    rows += [(1000 + i, rows[i + 1][1]) for i in range(30) if (i + 1) % 5]
    rows += [(2000 + i, prose(rng, 30) + " " + passage + " " + prose(rng, 30)) for i in range(6)]
    rows += [(3000 + i, prose(rng, 30) + " " + bench[i][1]) for i in range(3)]
    rows += [(4000, None), (4001, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("idiot" in t)) for i, t in rows[:400]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    steps = dict(corpus_pipeline.STAGES)
    assert len(steps) == 5
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{len(seen)}.parquet")
        before, now = now, spark.read.parquet(f"{tmp_path}/{len(seen)}.parquet")
        seen[name] = ([(r["doc_id"], r["text"]) for r in before.collect()], [(r["doc_id"], r["text"]) for r in now.collect()])

    was, kept = seen["toxicity"]
    toxic = {i for i, t in was if t and "idiot" in t}
    assert len(toxic & {i for i, _ in kept}) <= 0.05 * len(toxic) and {i for i, _ in was} - toxic <= {i for i, _ in kept}
    was, kept = seen["n-gram Jaccard join"]
    assert sorted(i for i, _ in kept) == sorted({c for _, _, c in brute_classes(was)})
    was, kept = seen["suffix-array dedup"]
    cut = {i: (n, gone) for i, n, gone, _, _ in brute_cut(was, 200)}
    assert all(len((t or "").encode()) >= cut[i][0] - cut[i][1] for i, t in kept) and not any(passage in (t or "") for _, t in kept)
    assert all(t == dict(was)[i] for i, t in kept if cut[i][1] == 0)
    was, kept = seen["benchmark decontamination"]
    clean = {r[0] for r in brute_hits(was, bench) if not r[-1]}
    assert {i for i, _ in kept} == clean and 3000 not in clean

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == collections.Counter(i for i, _ in kept)


def _folder(spark, path, docs, schema):
    spark.createDataFrame(docs, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int("idiot" in (r[1] or ""))) for r in docs if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, prose(random.Random(1), 20))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_stages_take_an_empty_table(spark, tmp_path):
    docs = _folder(spark, tmp_path, [], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0, name
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_odd_rows(spark, tmp_path):
    """Null ids, texts and other columns, repeated rows, an id with two texts, and further columns with names that stages use inside."""
    rng = random.Random(21)
    a, b = prose(rng, 60), prose(rng, 60)
    texts = [(1, a), (1, a), (1, b), (None, prose(rng, 50)), (None, None), (None, ""), (2, None), (3, ""), (3, ""), (4, "w " * 20_000), (5, a + " x")]
    rows = [(i, t, None, None if n % 2 else "s", None, "key", 7, "row", "sig", None, "spans", n) for n, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, id int, row string, sig string, _spans string, _k string, _gone int"
    docs = _folder(spark, tmp_path, rows, schema)
    out = {name: stage(spark, docs, str(tmp_path)) for name, stage in corpus_pipeline.STAGES}
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert out[name].columns == docs.columns
    assert out["toxicity"].count() == len(rows) and out["benchmark decontamination"].count() == len(rows)
    kept = sorted(((r["doc_id"], r["text"]) for r in out["n-gram Jaccard join"].collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (None, rows[3][1]), (None, None), (None, ""), (2, None), (3, ""), (4, rows[9][1])], key=str)
    cut = out["suffix-array dedup"].collect()
    assert sum(r["text"] is None for r in cut) == 2 and all(r["n_chars"] == len(r["text"]) for r in cut if r["text"] is not None)
    assert sum(r["piece"] == 0 for r in out["best-fit packing"].collect()) == len(rows)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
