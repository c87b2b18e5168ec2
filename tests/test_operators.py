"""Intervals, splits, metrics and statistics: known cases and invariants."""

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import calibration, curves, intervals, joins, leaderboard, metrics, ranking, splits, stats, thresholds, variants
from marlstone.sources import annotations, audio, manifests


def spans(df):
    return sorted((round(r["start_s"], 6), round(r["end_s"], 6)) for r in df.collect())


# ---------------------------------------------------------------------------- annotations and intervals


def test_rttm_and_gaps(spark):
    lines = ["SPEAKER file_001 1 0.0 5.0 <NA> <NA> a <NA> <NA>", "SPEAKER file_001 1 6.0 4.0 <NA> <NA> b <NA> <NA>", "SPEAKER file_002 1 1.0 3.0 <NA> <NA> a <NA> <NA>", "SPKR-INFO x", "SPEAKER bad 1 x y", "SPEAKER file_002 1 9 0 z"]
    f = annotations.parse_rttm(spark.createDataFrame([(x,) for x in lines], "value string"), "d", "dev")
    assert f.count() == 3 and f.columns == annotations.FRAME_COLUMNS
    assert spans(intervals.interval_gaps(f).filter("uri = 'file_001'")) == [(5.0, 6.0)]
    uem = annotations.parse_uem(spark.createDataFrame([("file_001 1 0 12",), ("file_002 1 2 20",), ("file_003 1 0 4",)], "value string"))
    assert spans(intervals.interval_gaps(f, uem).filter("uri = 'file_001'")) == [(5.0, 6.0), (10.0, 12.0)]
    assert spans(intervals.interval_gaps(f, uem).filter("uri = 'file_003'")) == [(0.0, 4.0)]
    cropped = intervals.crop_intervals(f, uem.filter("uri = 'file_002'"))
    assert spans(cropped.filter("uri = 'file_002'")) == [(2.0, 4.0)] and cropped.filter("uri = 'file_001'").count() == 2


def test_gaps_and_merged_cover_the_extent(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i % 5), float(a), float(a + rng.integers(1, 9))) for i, a in enumerate(rng.integers(0, 300, 200))]
    df = spark.createDataFrame(rows, "uri string, start_s double, end_s double")
    both = sorted(spans(intervals.merge_intervals(df, ["uri"]).filter("uri = '1'")) + spans(intervals.interval_gaps(df).filter("uri = '1'")))
    own = [(a, b) for u, a, b in rows if u == "1"]
    assert both[0][0] == min(a for a, _ in own) and both[-1][1] == max(b for _, b in own)
    assert all(x[1] == y[0] for x, y in zip(both, both[1:]))


def test_slices(spark):
    cut = lambda a, b, ds, cap=None: intervals.slice_intervals(spark.createDataFrame([(a, b)], "start_s double, end_s double"), ds, 1.0, cap)
    s = spans(cut(0.0, 10.0, [100]))
    assert len(s) == 80 and s[0] == (1.0, 1.1) and s[-1] == (8.9, 9.0)
    assert cut(0.0, 10.0, [100], 10).count() == 10 and cut(0.0, 2.0, [100]).count() == 0
    counts = {r["duration_ms"]: r["count"] for r in cut(0.0, 5.0, [20, 40, 100, 500, 1000]).groupBy("duration_ms").count().collect()}
    assert counts == {20: 150, 40: 75, 100: 30, 500: 6, 1000: 3}
    capped = intervals.cap_per_config(cut(0.0, 60.0, [100, 200]), ["duration_ms"], 7, ["start_s"])
    assert capped.count() == 14 and capped.agg(F.max("start_s")).first()[0] < 3


def test_first_rows_of_keys_without_ranking_all(spark):
    df = spark.range(20000).selectExpr("IF(id % 4 = 3, null, id % 4) AS k", "IF(id % 1999 = 0, null, CAST(id * 7919 % 20011 AS DOUBLE)) AS t", "id")
    df = df.unionByName(spark.createDataFrame([(9, 1.0, i) for i in range(300)] + [(8, None, i) for i in range(30)] + [(7, 5.0, 1)] * 40, df.schema)).repartition(5)
    near = intervals._near_start(df, ["k"], 7, ["t", "id"])
    assert near.filter("k IS NULL OR k < 3").count() < 400  # of 20,000
    first = lambda k: (k is not None, k or 0)
    rows = sorted(df.collect(), key=lambda r: (first(r["k"]), first(r["t"]), r["id"]))
    want = [tuple(r) for i, r in enumerate(rows) if i < 7 or rows[i - 7]["k"] != r["k"]]
    got = intervals.cap_per_config(df, ["k"], 7, ["t", "id"]).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(got) == 49
    assert intervals.cap_per_config(df, ["k"], 0, ["t", "id"]).count() == 0 == intervals.cap_per_config(df.limit(0), ["k"], 7, ["t", "id"]).count()


def test_thresholds_of_many_curves_by_bounded_tasks(spark):
    df = spark.range(2000).selectExpr("concat('c', id % 300) AS clip", "IF(id % 97 = 0, null, pmod(hash(id), 5) * 10) AS x", "pmod(hash(id, 1), 7) > 2 AS correct")
    got = curves.thresholds_of_many(df, "x", [50.0, 75.0], ["clip"], 100)
    assert got.rdd.getNumPartitions() == 20  # grows with the rows
    curve = curves.accuracy_curve(df, "x", ["clip"])
    want = [(r["clip"], t, r["threshold"]) for t in (50.0, 75.0) for r in curves.curve_threshold(curve, t, ["clip"]).collect()]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and any(t for _, _, t in want)
    assert curves.thresholds_of_many(df.limit(0), "x", [50.0], ["clip"]).count() == 0


def test_frame_table_checks(spark, tmp_path):
    df = spark.createDataFrame([("u", 0.0, 1.0, "SPEECH", "dev", "d")], annotations.FRAME_SCHEMA)
    annotations.write_frame_table(df, f"{tmp_path}/t")
    assert annotations.read_frame_table(spark, f"{tmp_path}/t").collect() == df.collect()
    with pytest.raises(ValueError, match="Missing required column"):
        annotations.write_frame_table(df.drop("label"), f"{tmp_path}/x")


# ---------------------------------------------------------------------------- splits


@pytest.fixture(scope="module")
def clips(spark):
    rows = [(i, i // 4, f"set{i % 3}", "SPEECH" if i % 5 else "NONSPEECH", 20 * (i % 4), None if i % 7 == 0 else i % 3) for i in range(400)]
    return spark.createDataFrame(rows, "clip_id long, group_id long, dataset string, ground_truth string, duration_ms int, snr_db int").cache()


def test_balance(spark):
    rows = [(i, "clean" if i < 100 else "noise") for i in range(120)] + [(500, None)]
    out = splits.balance_to_min(spark.createDataFrame(rows, "clip_id int, c string"), ["c"], "clip_id")
    assert {r["c"]: r["count"] for r in out.groupBy("c").count().collect()} == {"clean": 20, "noise": 20}


@pytest.mark.parametrize("make", [lambda d: splits.split_groups(d, {"train": 0.5, "dev": 20, "test": None}, 3), lambda d: splits.split_groups_by_majority(d, 0.2, 3), lambda d: splits.split_clips_stratified(d, 0.2, 3, "group_id")])
def test_group_splits_do_not_leak(clips, make):
    out = make(clips)
    assert out.count() == 400 and joins.leakage_audit(out, "group_id", "split")[1].count() == 0
    same = make(clips.repartition(7)).select("clip_id", "split")
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, out.select("clip_id", "split").collect()))


def test_split_sizes(clips):
    sizes = lambda df: {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    assert sizes(splits.split_rows_random(clips, 0.8)) == {"train": 320, "test": 80}
    assert sizes(splits.split_balanced_ratios(clips, 0.7, 0.2)) == {"train": 112, "dev": 32, "test": 16}
    with pytest.raises(ValueError):
        splits.split_groups(clips, {"train": 90, "test": 90})
    rows = splits.split_rows_stratified(clips, ["ground_truth", "clip_id"], ["ground_truth"], 0.25)
    assert sizes(rows) == {"test": 100, "train": 300}


def test_samples(clips):
    assert splits.sample_uniform(clips, 30).count() == 30
    half = splits.sample_half_half(clips, 400)
    assert {r["ground_truth"]: r["count"] for r in half.groupBy("ground_truth").count().collect()} == {"SPEECH": 200, "NONSPEECH": 200}
    per = splits.sample_per_condition(clips, ["duration_ms", "snr_db"], 2, 1000)
    assert per.groupBy("duration_ms", "snr_db").count().agg(F.max("count")).first()[0] == 2 and per.filter("snr_db is null").count() > 0
    assert splits.compose_by_share(clips, {"set0": 0.5, "set1": 0.9, "set2": 0}, 100, "dataset").count() == 50 + 90


# ---------------------------------------------------------------------------- metrics


@pytest.fixture(scope="module")
def preds(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        truth = "SPEECH" if rng.random() < 0.4 else "NONSPEECH"
        score = float(np.round(np.clip(rng.normal(0.6 if truth == "SPEECH" else 0.45, 0.2), 0, 1), 2))
        p = "SPEECH" if score > 0.5 else "NONSPEECH"
        rows.append((i, truth, score, p, p == truth, int(rng.choice([20, 50, 100, 400])), float(rng.normal())))
    return spark.createDataFrame(rows, "clip_id int, ground_truth string, score double, prediction string, correct boolean, duration_ms int, other double").cache()


def arrays(preds):
    p = preds.toPandas()
    return (p.ground_truth == "SPEECH").to_numpy(), p.score.to_numpy()


def test_sweeps_equal_brute_force(preds):
    y, s = arrays(preds)
    for strict in (True, False):
        curve = thresholds.ba_curve(preds, 0.1, 0.01, 85, [], strict).orderBy("index").collect()
        for r in curve:
            t = 0.1 + r["index"] * 0.01
            hit = s > t if strict else s >= t
            assert r["ba"] == pytest.approx((hit[y].mean() + (~hit)[~y].mean()) / 2)
    best = thresholds.sweep_threshold(preds).first()
    values = [(s > 0.1 + i * 0.01)[y].mean() / 2 + (s <= 0.1 + i * 0.01)[~y].mean() / 2 for i in range(85)]
    assert best["best_index"] == int(np.argmax(values)) and best["best_ba"] == pytest.approx(max(values))


def test_auc_and_ap(preds):
    y, s = arrays(preds)
    wins = (s[y][:, None] > s[~y]).mean() + (s[y][:, None] == s[~y]).mean() / 2
    assert ranking.roc_auc(preds, []).first()["auc"] == pytest.approx(wins)
    flipped = preds.withColumn("score", -F.col("score"))
    assert ranking.roc_auc(flipped, []).first()["auc"] == pytest.approx(1 - wins)
    ap = sum((y & (s == t)).sum() / y.sum() * y[s >= t].mean() for t in np.unique(s))
    assert ranking.average_precision(preds, []).first()["ap"] == pytest.approx(ap)
    assert ranking.roc_auc(preds.filter("ground_truth = 'SPEECH'"), []).first()["auc"] is None
    ci = {r["metric"]: r for r in stats.bootstrap_auc(preds, 200).collect()}
    assert ci["auc"]["low"] < wins < ci["auc"]["high"] and ci["ap"]["low"] < ap < ci["ap"]["high"]


def test_absent_classes_and_wilson(preds, spark):
    only = preds.filter("ground_truth = 'SPEECH'")
    zero, skip = (metrics.balanced_accuracy(only, [], absent=a).first()["ba"] for a in ("zero", "skip"))
    assert skip == pytest.approx(2 * zero)
    w = metrics.wilson_interval(spark.createDataFrame([(0, 0), (5, 10), (10, 10)], "n_correct int, n int")).orderBy("n", "n_correct").collect()
    assert (w[0]["ci_low"], w[0]["ci_high"]) == (0, 0) and w[1]["ci_low"] == pytest.approx(0.2366, abs=1e-3) and w[2]["ci_high"] == 1.0


def test_calibration(preds):
    assert calibration.ece(preds.withColumn("p", F.lit(1.0)), prob="p").first()["ece"] == 0
    y, s = arrays(preds)
    assert calibration.brier(preds, "score").first()["brier"] == pytest.approx(((s - y) ** 2).mean())
    logits = preds.withColumn("logit_diff", (F.col("score") - 0.5) * 30)
    t = calibration.find_temperature(logits, [1.0, 2.0, 5.0, 10.0, 20.0]).first()
    assert t["ece_after"] <= t["ece_before"] and t["temperature"] > 1
    one = calibration.ece(calibration.at_temperatures(logits, [t["temperature"]]), prob="prob").first()["ece"]
    assert one == pytest.approx(t["ece_after"])


def test_tails():
    assert stats.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and stats.chi2_tail(18.307, 10) == pytest.approx(0.05, abs=1e-5)
    assert stats.t_tail(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and stats.t_tail(0, 5) == pytest.approx(1)
    assert stats.chi2_tail(1.7, 1) == pytest.approx(math.erfc(math.sqrt(0.85)), abs=1e-10)


def test_mcnemar(spark):
    """A has 5 rows right that B has wrong, B 15 that A has wrong: A is the worse one, so effects are negative, (5 - 15) / 20 and (5 - 15) / sqrt(20)."""
    rows = [(True, True)] * 50 + [(True, False)] * 5 + [(False, True)] * 15 + [(False, False)] * 30
    r = stats.mcnemar(spark.createDataFrame(rows, "correct_a boolean, correct_b boolean")).first()
    assert (r["n10"], r["n01"]) == (5, 15) and r["chi2"] == pytest.approx(81 / 20) and r["p_value"] == pytest.approx(0.04417, abs=1e-4)
    assert r["effect"] == pytest.approx(-0.5) and r["cohen_g"] == pytest.approx(-2.2360680)
    same = stats.mcnemar(spark.createDataFrame([(True, True)], "correct_a boolean, correct_b boolean")).first()
    assert (same["chi2"], same["p_value"]) == (0, 1)
    level = stats.mcnemar(spark.createDataFrame([(True, False)] * 4 + [(False, True)] * 4, "correct_a boolean, correct_b boolean")).first()
    assert level["chi2"] == pytest.approx(1 / 8) and level["effect"] == 0 and level["p_value"] == pytest.approx(0.7237, abs=1e-4)


def test_compare_models_agrees_in_sign(spark):
    rows = [("SPEECH", True, True)] * 50 + [("NONSPEECH", False, True)] * 20 + [("SPEECH", True, False)] * 5 + [("NONSPEECH", False, False)] * 5
    pairs = spark.createDataFrame([(t, t, a, b) for t, a, b in rows], "ground_truth_a string, ground_truth_b string, correct_a boolean, correct_b boolean")
    r = stats.compare_models(pairs, n=200).first()
    assert r["difference"] == pytest.approx(r["difference"]) and r["difference"] < 0 and r["effect"] == pytest.approx(-0.6)


def test_bootstrap_auc_of_many_scores(spark):
    """More distinct scores than a task would hold at once: the median is near the value itself, whatever the ranges."""
    rng = np.random.default_rng(5)
    n = 3000
    y = rng.random(n) < 0.4
    score = np.where(y, rng.beta(40, 2, n), rng.beta(30, 2, n))  # crowded near 1
    df = spark.createDataFrame([("SPEECH" if a else "NONSPEECH", float(b)) for a, b in zip(y, score)], "ground_truth string, score double").repartition(3)
    auc, ap = ranking.roc_auc(df, []).first()["auc"], ranking.average_precision(df, []).first()["ap"]
    for parts in (1, 7):
        got = {r["metric"]: r for r in stats.bootstrap_auc(df, n=200, parts=parts).collect()}
        assert got["auc"]["median"] == pytest.approx(auc, abs=0.004) and got["ap"]["median"] == pytest.approx(ap, abs=0.006)
        assert got["auc"]["n_valid"] == 200 and got["auc"]["low"] < auc < got["auc"]["high"] and got["auc"]["high"] - got["auc"]["low"] < 0.06
    rough = {r["metric"]: r["median"] for r in stats.bootstrap_auc(df, n=100, bins=4096).collect()}
    assert rough["auc"] == pytest.approx(auc, abs=0.01)


def test_places_within_keys(spark):
    """A key that holds most rows, and a null one; ranks follow hash order in each."""
    rows = [(i, "a" if i % 10 else ("b" if i % 20 else None)) for i in range(2000)]
    df = spark.createDataFrame(rows, "clip_id long, k string").repartition(5)
    got = collections.defaultdict(list)
    for r in splits._placed(df, ["k"], "clip_id", 4).collect():
        got[r["k"]].append((r["_place"], r["clip_id"], r["_size"]))
    digest = lambda i: hashlib.md5(f"{i}|4".encode()).hexdigest()
    for k in ("a", "b", None):
        want = sorted((i for i, v in rows if v == k), key=lambda i: (digest(i), i))
        assert sorted(got[k]) == [(n + 1, i, len(want)) for n, i in enumerate(want)]


@pytest.mark.parametrize("n,rows", [(0, 0), (1, 0), (2, 2), (9, 8)])
def test_half_half_counts(spark, n, rows):
    df = spark.createDataFrame([(i, "SPEECH" if i < 3 else "NONSPEECH") for i in range(40)], "clip_id long, ground_truth string")
    assert splits.sample_half_half(df, n).count() == rows


def test_band_pass_gains():
    """A Butterworth band-pass of order 4 between 300 and 3400 Hz at 16 kHz, forward and backward: one half at its edges, one at the centre."""
    w1, w2 = np.tan(np.pi * 300 / 16000), np.tan(np.pi * 3400 / 16000)
    centre = np.arctan(np.sqrt(w1 * w2)) * 16000 / np.pi
    gain = variants.butterworth_response(np.array([0.0, 300.0, centre, 3400.0, 8000.0, 150.0, 6800.0]), 16000, "telephony")
    assert gain[[1, 2, 3]] == pytest.approx([0.5, 1.0, 0.5], abs=1e-9) and gain[0] < 1e-12 and gain[4] < 1e-12
    # The analog prototype at w: 1 / (1 + ((w^2 - w1 w2) / (w (w2 - w1)))^8), by hand at 150 Hz.
    w = np.tan(np.pi * 150 / 16000)
    assert gain[5] == pytest.approx(1 / (1 + ((w * w - w1 * w2) / (w * (w2 - w1))) ** 8)) and gain[6] < 0.01
    assert variants.butterworth_response(np.array([3400.0]), 16000, "lowpass") == pytest.approx([0.5]) and variants.butterworth_response(np.array([300.0]), 16000, "highpass") == pytest.approx([0.5])


def test_spearman_and_chi2(preds):
    p = preds.toPandas()
    want = p.duration_ms.rank().corr(p.score.rank())
    assert stats.spearman(preds, "duration_ms", "score").first()["rho"] == pytest.approx(want)
    two = preds.withColumn("c", F.col("correct").cast("string"))
    t = p.groupby(["ground_truth", "correct"]).size().unstack().to_numpy().astype(float)
    e = t.sum(1, keepdims=True) * t.sum(0) / t.sum()
    gap = np.abs(t - e)
    r = stats.chi2_independence(two, "ground_truth", "c").first()
    assert r["dof"] == 1 and r["chi2"] == pytest.approx(((gap - np.minimum(0.5, gap)) ** 2 / e).sum())


def test_curves(spark):
    x = np.array([20, 40, 80, 160, 320, 640], float)
    n = np.full(6, 4000)
    k = np.round(n * curves.curve_value(x, 0.02, 100, 0.03, 0.5)).astype(int)
    fit = curves.fit_cells(x, n, k)
    assert fit["x50"] == pytest.approx(100, rel=0.1) and fit["slope"] == pytest.approx(0.02, rel=0.15) and 0 <= fit["lapse"] <= 0.1
    rows = [(float(a), i < int(b)) for a, b in zip(x, k // 40) for i in range(100)]
    df = spark.createDataFrame(rows, "x double, correct boolean")
    t = curves.curve_threshold(curves.accuracy_curve(df, "x"), 75.0).first()["threshold"]
    b = curves.bootstrap_curve_threshold(df, "x", 75.0, 200).first()
    assert b["low"] <= t <= b["high"]
    assert curves.curve_threshold(curves.accuracy_curve(df, "x"), 10.0).first()["threshold"] is None


def test_votes_and_boards(spark, preds):
    v = spark.createDataFrame([(1, "SPEECH", "SPEECH"), (1, "SPEECH", "NONSPEECH"), (2, "NONSPEECH", "SPEECH")], "clip_id int, ground_truth string, prediction string")
    assert {r["clip_id"]: r["prediction"] for r in metrics.clip_vote(v).collect()} == {1: "SPEECH", 2: "SPEECH"}
    h = spark.createDataFrame([(i, r) for i, r in enumerate([0.1, 0.3, 0.2, 0.3, 0.25, 0.5])], "iteration int, reward double")
    out = leaderboard.best_so_far(h, 3).orderBy("iteration").collect()
    assert [r["since"] for r in out] == [0, 0, 1, 2, 3, 0] and [r["stop"] for r in out] == [False] * 4 + [True, False]
    b = stats.bootstrap_accuracy(preds, [], 2000).first()
    assert b["low"] < 100 * b["k"] / b["n"] < b["high"]


# ---------------------------------------------------------------------------- files and waveforms


def test_predictions_and_manifests(spark, tmp_path):
    a = spark.createDataFrame([("c", "SPEECH", True)], "clip_id string, ground_truth string, correct boolean")
    b = spark.createDataFrame([("c", "SPEECH", "NONSPEECH")], "clip_id string, y_true string, y_pred string")
    u = manifests.union_predictions({"a": a, "b": b}).collect()
    assert {r["run"]: r["correct"] for r in u} == {"a": True, "b": False}
    (tmp_path / "p.json").write_text('{"predictions": [1, 0],\n "ground_truth": [1, 1]}')
    assert [tuple(r) for r in manifests.read_prediction_arrays(spark, f"{tmp_path}/p.json").collect()] == [(0, 1, 1), (1, 0, 1)]
    (tmp_path / "t.json").write_text('{"format": "ab", "label_space": ["SPEECH"], "templates": [{"id": "x", "text": "q", "mapping": {"A": "SPEECH"}, "verbalizers": ["A"]}, {"id": "y", "text": "r", "mapping": null, "verbalizers": []}]}')
    assert [r["mapping"] for r in manifests.read_prompt_templates(spark, f"{tmp_path}/t.json").orderBy("id").collect()] == [{"A": "SPEECH"}, None]
    manifests.append_jsonl_log(a, f"{tmp_path}/log")
    manifests.append_jsonl_log(a, f"{tmp_path}/log")
    assert manifests.read_jsonl_log(spark, f"{tmp_path}/log").count() == 2
    manifests.write_splits(a.withColumn("split", F.lit("dev")), f"{tmp_path}/s", "csv")
    assert manifests.read_manifest(spark, f"{tmp_path}/s").count() == 1
    (tmp_path / "ava.csv").write_text("v,0.0,0.04,SPEECH_CLEAN\nv,0.04,0.08,NO_SPEECH\nw,0,0.04,SPEECH_WITH_MUSIC\n")
    ava = annotations.read_ava(spark, f"{tmp_path}/ava.csv", "ava", "train").orderBy("uri", "start_s").collect()
    assert [(r["label"], r["condition"]) for r in ava] == [("SPEECH", "clean"), ("NONSPEECH", "none"), ("SPEECH", "music")]
    found, missing, ratio = joins.manifest_coverage(a, a.filter("false"), "clip_id")
    with pytest.raises(ValueError):
        joins.check_coverage(ratio, 0.5)


def test_wav_corpus(spark, tmp_path):
    x = np.sin(np.arange(1600) / 5) * 0.5
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.wav").write_bytes(audio.encode_wav(x, 16000))
    (tmp_path / "bad.wav").write_bytes(b"RIFF" + b"\0" * 2000)
    (tmp_path / "small.wav").write_bytes(b"x")
    rows = {r["path"].rpartition("/")[2]: r for r in audio.read_wav_corpus(spark, str(tmp_path)).collect()}
    assert set(rows) == {"x.wav", "bad.wav"} and rows["bad.wav"]["error"] and rows["x.wav"]["sr"] == 16000
    assert np.allclose(rows["x.wav"]["samples"], x, atol=1e-3)


def test_waveform_helpers():
    rng = variants.rng_of("k", 1)
    x = np.sin(np.arange(4000) / 7)
    y, snr, silent = variants.add_white_noise(x, 10, 0, 4000, rng)
    assert not silent and np.sqrt(np.mean(x**2)) / np.sqrt(np.mean((y - x) ** 2)) == pytest.approx(10**0.5)
    assert variants.add_white_noise(np.zeros(100), 5, 0, 100, rng)[1:] == (None, True)
    t = np.arange(16000) / 16000
    tone = lambda f: np.sin(2 * np.pi * f * t)[None, :]
    gain = lambda f, k: np.sqrt((variants.band_filter(tone(f), 16000, k)[0][2000:-2000] ** 2).mean() / 0.5)
    assert gain(1000, "telephony") == pytest.approx(1, abs=0.02) and gain(50, "telephony") < 0.01 and gain(7000, "lowpass") < 0.05 and gain(3400, "lowpass") == pytest.approx(0.5, abs=0.02)
    rir = variants.synthetic_rir(0.3, 16000)
    assert np.abs(rir).max() == 1 and len(variants.synthetic_rir(0.0, 16000)) == 1
    wet = variants.apply_rir(tone(400), rir)
    assert wet.shape == (1, 16000) and np.sqrt((wet**2).mean()) == pytest.approx(np.sqrt(0.5), rel=1e-6)
    assert np.allclose(variants.apply_rir(tone(400), np.ones(1)), tone(400))
    power = lambda c: np.abs(np.fft.rfft(variants.coloured_noise(1 << 14, c, variants.rng_of(c, 0)))) ** 2
    slope = {c: np.log10(power(c)[10:100].mean() / power(c)[1000:8000].mean()) for c in ("white", "pink", "brown")}
    assert slope["white"] < 0.5 < slope["pink"] < slope["brown"]


def test_rendered_variants(spark):
    x = (np.sin(np.arange(1000) / 3) * 0.3).tolist()
    clips = spark.createDataFrame([(1, x, 1000), (2, x, 1000)], "clip_id int, samples array<double>, sr int")
    rows = variants.render_variants(clips).collect()
    assert len(rows) == 40 and all(len(r["samples"]) == 2000 for r in rows)
    again = {r["variant_id"]: r["samples"] for r in variants.render_variants(clips.repartition(2)).collect()}
    assert all(again[r["variant_id"]] == r["samples"] for r in rows)
    quiet = {r["snr_db"]: r["rms"] for r in rows if r["variant_type"] == "snr" and r["clip_id"] == 1}
    assert quiet[-10] > quiet[0] > quiet[20]
    n = variants.noise_corpus(spark, 10, {("white", 0.0): 0.5, ("brown", -6.0): 0.5}, 1000, 100)
    assert {r["colour"]: r["count"] for r in n.groupBy("colour").count().collect()} == {"white": 5, "brown": 5}
    qc = variants.audio_qc(clips, 1000, 1000)
    assert qc.filter("ok").count() == 2 and variants.audio_qc_extremes(qc, 1).count() == 2 and variants.audio_qc_issues(qc).count() == 0
