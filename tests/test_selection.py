"""Apportioned splits, selection by narrowing ranges, interval scans and joins, against plain Python."""

import collections
import hashlib
import json
import random

import numpy as np
import pytest

from marlstone.operators import calibration, common, intervals, joins, leaderboard, metrics, splits
from marlstone.sources import manifests

# ---------------------------------------------------------------------------- splits


def strata(spark, n, size):
    return spark.createDataFrame([(f"c{i}", f"s{i // size}", "ab"[i // size % 2]) for i in range(n * size)], "clip_id string, stratum string, label string")


@pytest.mark.parametrize("test_size,want", [(0.15, 45), (0.2, 60), (0.35, 105), (0.5, 150)])
def test_the_total_of_a_stratified_split_is_kept(spark, test_size, want):
    """100 strata of three rows: rounding each alone would test none, or one of each."""
    rows = splits.split_rows_stratified(strata(spark, 100, 3), ["stratum"], ["label"], test_size, 1).collect()
    tested = collections.Counter(r["stratum"] for r in rows if r["split"] == "test")
    assert len(rows) == 300 and sum(tested.values()) == want
    if want >= 100:  # fewer rows than strata are dealt by label
        assert all(abs(tested[f"s{i}"] - 3 * test_size) < 1 for i in range(100))


def test_largest_remainders(spark):
    sizes = spark.createDataFrame([("a", 41), ("b", 29), ("c", 17), ("d", 13), (None, 0)], "k string, _size long")
    got = {r["k"]: r["_seats"] for r in splits.apportioned(sizes, ["k"], 10, 100).collect()}
    assert got == {"a": 4, "b": 3, "c": 2, "d": 1, None: 0}  # 4.1, 2.9, 1.7, 1.3: two seats are left, for b and c


@pytest.mark.parametrize("most", [10_000, 3])
def test_a_sample_of_any_size_is_a_cut_through_the_hashes(spark, most):
    ids = [f"x{i}" for i in range(800)] + ["twice"] * 40
    df = spark.createDataFrame([(i,) for i in ids], "clip_id string").repartition(5)
    order = sorted(ids, key=lambda i: (hashlib.md5(f"{i}|7".encode()).hexdigest(), i))
    for n in (0, 1, 13, 420, order.index("twice") + 5, 839, 840, 2000):
        got = common.first_by_hash(df, n, ["clip_id"], 7, most).collect()
        assert sorted(r[0] for r in got) == sorted(order[:n])
    plan = common.first_by_hash(df, 420, ["clip_id"], 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and "Limit" not in plan


# ---------------------------------------------------------------------------- quantiles and numbers


@pytest.mark.parametrize("most", [50_000, 4])
def test_exact_quantiles(spark, most):
    rng = np.random.default_rng(3)
    groups = {"normal": rng.normal(size=700), "ties": rng.integers(0, 3, 500).astype(float), "two": np.repeat([1.0, 2.0], 300), "wide": 10 ** rng.uniform(-200, 200, 300), "one": np.array([4.0]), None: np.array([5.0, 7.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("normal", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = {"low": 0.0, "q": 0.25, "m": 0.5, "u": 0.975, "high": 1.0}
    got = {r["g"]: r for r in common.quantiles(df, ["g"], "v", shares, 16, most).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        for name, q in shares.items():
            assert got[g][name] == pytest.approx(np.quantile(values, q), rel=1e-12)
    whole = common.quantiles(df, [], "v", {"m": 0.5}, 16, most).collect()
    assert whole[0]["m"] == pytest.approx(np.quantile(np.concatenate(list(groups.values())), 0.5))
    assert common.quantiles(df.limit(0), [], "v", {"m": 0.5}).collect() == []


def test_quantiles_of_repeated_values_read_rows_once(spark, monkeypatch):
    """Many rows of few values need no ranges: rows are counted by value once, later steps read the counts."""
    names, before = [], common.written
    monkeypatch.setattr(common, "written", lambda df, name: names.append((name, df.count())) or before(df, name))
    df = spark.range(4000).selectExpr("id % 2 AS g", "CAST(id % 10 AS DOUBLE) AS v")
    got = {r["g"]: r["m"] for r in common.quantiles(df, ["g"], "v", {"m": 0.5}, 16, 100).collect()}
    assert got == {0: 4.0, 1: 5.0} and names == [("quantile-values", 10), ("quantile-spans", 2)]


def test_numbers_within_keys(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i * 37 % 500) for i in range(500)]
    placed, sizes = common.numbered(spark.createDataFrame(rows, "k string, v long").repartition(6), ["v"], ["k"])
    got, size = collections.defaultdict(list), {r["k"]: r["_size"] for r in sizes.collect()}
    for r in placed.collect():
        got[r["k"]].append((r["_place"], r["v"]))
    for k, values in got.items():
        assert sorted(values) == list(enumerate(sorted(v for a, v in rows if a == k))) and size[k] == len(values)


def test_noise_comes_from_the_whole_pool_of_its_type(spark):
    clips = spark.createDataFrame([(f"c{i}", "ab"[i % 2]) for i in range(400)], "clip_id string, kind string")
    pool = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "noise_id long, kind string")
    rows = joins.assign_noise(clips, pool, type_col="kind").collect()
    assert len(rows) == 400 and all("ab"[r["noise_id"] % 2] == r["kind"] for r in rows) and len({r["noise_id"] for r in rows}) == 20


# ---------------------------------------------------------------------------- intervals


def merged_by_hand(rows):
    out = []
    for uri, a, b in sorted(r for r in rows if r[2] > r[1]):
        if out and out[-1][0] == uri and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([uri, a, b])
    return [tuple(r) for r in out]


@pytest.fixture(scope="module")
def timeline():
    rng = random.Random(8)
    rows = [("hot", float(a := rng.randint(0, 20000)), a + rng.choice([0.0, 1.0, 3.0, 8.0])) for _ in range(1500)] + [("hot", 5000.0, 7000.0)]
    return rows + [(f"u{i % 5}", float(a := rng.randint(0, 50)), a + 4.0) for i in range(40)] + [("empty", 3.0, 3.0), ("back", 5.0, 4.0)]


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_one_long_recording_is_merged_by_ranges_of_time(spark, timeline, parts):
    df = spark.createDataFrame(timeline, "uri string, start_s double, end_s double").repartition(4)
    got = sorted(tuple(r) for r in intervals.merge_intervals(df, ["uri"], parts).collect())
    want = merged_by_hand(timeline)
    assert got == want
    gaps = sorted(tuple(r) for r in intervals.interval_gaps(df, parts=parts).collect())
    assert gaps == [(a[0], a[2], b[1]) for a, b in zip(want, want[1:]) if a[0] == b[0]]


def test_gaps_inside_given_extents(spark):
    df = spark.createDataFrame([("a", 2.0, 4.0), ("a", 6.0, 7.0), ("c", 1.0, 2.0)], "uri string, start_s double, end_s double")
    extents = spark.createDataFrame([("a", 0.0, 6.5), ("b", 1.0, 3.0)], "uri string, start_s double, end_s double")
    got = sorted(tuple(r) for r in intervals.interval_gaps(df, extents).collect())
    assert got == [("a", 0.0, 2.0), ("a", 4.0, 6.0), ("b", 1.0, 3.0)]


def test_segments_meet_regions_of_their_time_only(spark, timeline):
    rng = random.Random(9)
    regions = [("hot", float(a := rng.randint(0, 20000)), a + rng.choice([1.0, 5.0, 40.0])) for _ in range(800)] + [("u1", 0.0, 30.0), ("u2", 10.0, 10.0), ("other", 0.0, 9.0)]
    schema = "uri string, start_s double, end_s double"
    got = collections.Counter(tuple(r) for r in intervals.crop_intervals(spark.createDataFrame(timeline, schema), spark.createDataFrame(regions, schema)).collect())
    known, want = {r[0] for r in regions}, collections.Counter()
    for uri, a, b in timeline:
        if uri not in known:
            want[uri, a, b] += 1
        for _, c, d in (r for r in regions if r[0] == uri and a < r[2] and b > r[1]):
            want[uri, max(a, c), min(b, d)] += 1
    assert got == want


def test_pairs_looked_at_grow_with_the_segments(spark):
    """20,000 segments and regions of one recording: a join by recording alone would look at 400 million pairs."""
    rows = spark.range(20_000).selectExpr("'u' AS uri", "CAST(id AS DOUBLE) AS start_s", "id + 1.5D AS end_s")
    assert intervals.crop_intervals(rows, rows).count() == 20_000 + 2 * 19_999


# ---------------------------------------------------------------------------- rules at the edges


def test_a_logit_of_zero_is_predicted_positive(spark):
    df = spark.createDataFrame([("SPEECH", 0.0), ("NONSPEECH", 0.0), ("NONSPEECH", 0.0)], "ground_truth string, logit_diff double")
    row = calibration.find_temperature(df).first()
    assert row["ece_before"] == pytest.approx(0.5 - 1 / 3) and row["temperature"] == pytest.approx(0.1)  # all temperatures alike: the first
    assert {r["correct"] for r in calibration.at_temperatures(df, [1.0, 3.0]).filter("ground_truth = 'SPEECH'").collect()} == {True}


def test_the_temperature_is_no_worse_than_any_on_a_grid(spark):
    rng = np.random.default_rng(5)
    logit = rng.normal(0, 4, 400)
    truth = rng.random(400) < 1 / (1 + np.exp(-logit / 2.7))
    rows = [("g1", "SPEECH" if t else "NONSPEECH", float(x)) for t, x in zip(truth, logit)] + [("g2", "SPEECH" if t else "NONSPEECH", float(3 * x)) for t, x in zip(truth, logit)]
    got = {r["g"]: r for r in calibration.find_temperature(spark.createDataFrame(rows, "g string, ground_truth string, logit_diff double"), by=["g"]).collect()}

    def error(x, t):
        p = 1 / (1 + np.exp(-x / t))
        b, out = np.minimum((p * 10).astype(int), 9), 0.0
        for i in range(10):
            m = b == i
            if m.any():
                out += m.sum() / len(p) * abs(p[m].mean() - ((p[m] >= 0.5) == truth[m]).mean())
        return out

    for g, scale in (("g1", 1), ("g2", 3)):
        assert 0.1 <= got[g]["temperature"] <= 10
        assert got[g]["ece_after"] <= min(error(scale * logit, t) for t in np.linspace(0.1, 10, 100)) + 1e-9
        assert got[g]["ece_after"] == pytest.approx(error(scale * logit, got[g]["temperature"]))
        assert got[g]["ece_before"] == pytest.approx(error(scale * logit, 1.0))


def test_any_two_different_predictions_disagree(spark):
    rows = [("a", 1, "NONSPEECH", False), ("a", 2, "UNKNOWN", False), ("b", 1, "SPEECH", True), ("b", 2, "SPEECH", True), ("c", 2, "SPEECH", True), ("c", 3, "NONSPEECH", False), ("d", 1, "SPEECH", True), ("d", 3, "UNKNOWN", False)]
    df = spark.createDataFrame([(*r, "SPEECH", i) for i, r in enumerate(rows)] + [("b", 1, "UNKNOWN", False, "SPEECH", 99)], "clip_id string, run int, prediction string, correct boolean, ground_truth string, o int")
    got = {r["clip_id"]: r for r in leaderboard.seed_disagreements(df, ["o"]).collect()}
    assert set(got) == {"a", "d"}  # c has no row of the smallest seed; b's second row of a seed does not count
    assert got["a"]["predictions"] == {1: "NONSPEECH", 2: "UNKNOWN"} and got["d"]["correct_flags"] == {1: True, 3: False}
    assert got["a"]["agreement_rate"] == 0 and got["d"]["agreement_rate"] == 0.5 and got["d"]["n_seeds"] == 2


def test_the_metrics_document_has_all_levels_and_quotes_any_key(spark):
    rows = [('a"b', "x\\y", "SPEECH", True), ('a"b', "x\\y", "NONSPEECH", False), ('a"b', "z", "SPEECH", False), ("plain", None, "SPEECH", True)]
    df = spark.createDataFrame(rows, "variant_type string, condition string, ground_truth string, correct boolean")
    doc = json.loads(manifests.metrics_document(df, {"mode": "base", "threshold": 0.5}).first()["document"])
    assert doc["mode"] == "base" and doc["n_samples"] == 4 and doc["overall"] == {"ba": pytest.approx(1 / 3), "speech_acc": pytest.approx(2 / 3), "nonspeech_acc": 0.0}
    quoted = doc["by_variant_type"]['a"b']
    assert (quoted["ba"], quoted["n_samples"], set(quoted["conditions"])) == (0.25, 3, {"x\\y", "z"})
    assert quoted["conditions"]["x\\y"] == {"ba": 0.5, "speech_acc": 1.0, "nonspeech_acc": 0.0, "n_samples": 2, "n_speech": 1, "n_nonspeech": 1}
    assert doc["by_variant_type"]["plain"]["n_samples"] == 1 and "conditions" not in doc["by_variant_type"]["plain"]


def test_a_clip_counts_once(spark):
    rows = [("a", "SPEECH", "SPEECH")] * 3 + [("a", "SPEECH", "NONSPEECH")] * 2 + [("b", "NONSPEECH", "SPEECH")] * 5 + [("c", "NONSPEECH", "NONSPEECH")]
    df = spark.createDataFrame(rows, "clip_id string, ground_truth string, prediction string")
    row = metrics.clip_metrics(df).first()
    assert (row["n_clips"], row["accuracy"], row["ba"]) == (3, pytest.approx(2 / 3), 0.75)
    assert row["macro_f1"] == pytest.approx((2 / 3 + 2 / 3) / 2)
