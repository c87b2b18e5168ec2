"""Fitted curves, resampled crossings, filters by sections, noise in containers and declared column types."""

import numpy as np
import pytest

from marlstone.operators import curves, variants
from marlstone.sources import manifests


def loss_of(x, n, k, slope, x50, lapse):
    p = np.clip(curves.curve_value(x, slope, x50, lapse, 0.5), 1e-9, 1 - 1e-9)
    return -(k * np.log(p) + (n - k) * np.log(1 - p)).sum()


def test_known_parameters_come_back():
    x = np.array([20, 40, 80, 120, 160, 240, 320, 640, 1000], float)
    truth = [(0.02, 100.0, 0.03), (0.05, 60.0, 0.0), (0.01, 200.0, 0.08), (0.1, 130.0, 0.02)]
    n = np.full((4, 9), 1e7)
    k = np.array([n[0] * curves.curve_value(x, *t, 0.5) for t in truth])
    got = curves.fit_batch(np.tile(x, (4, 1)), n, k)
    for i, (slope, x50, lapse) in enumerate(truth):
        assert got["slope"][i] == pytest.approx(slope, rel=0.01) and got["x50"][i] == pytest.approx(x50, rel=0.01) and got["lapse"][i] == pytest.approx(lapse, abs=1e-3)
        assert curves.curve_value(got["dt75"][i], slope, x50, lapse, 0.5) == pytest.approx(0.75, abs=1e-3) and got["dt50"][i] == got["x50"][i]


def test_no_likelihood_is_below_a_grids():
    rng = np.random.default_rng(4)
    x = np.array([20, 40, 60, 80, 100, 200, 500, 1000], float)
    n = rng.integers(0, 60, (25, 8)) * 1.0
    n[:, 0] += 1
    k = np.floor(n * rng.uniform(0.3, 1, (25, 8)))
    k[:5] = np.floor(n[:5] * curves.curve_value(x, 0.03, 90, 0.02, 0.5))
    got = curves.fit_batch(np.tile(x, (25, 1)), n, k)
    for i in range(25):
        grid = min(loss_of(x, n[i], k[i], s, c, v) for s in np.geomspace(0.5, 200, 30) / 980 for c in np.linspace(-470, 1000, 40) for v in (0, 0.02, 0.05, 0.1))
        assert got["loss"][i] <= grid + 1e-6
        assert 0 <= got["lapse"][i] <= 0.1 and got["loss"][i] == pytest.approx(loss_of(x, n[i], k[i], got["slope"][i], got["x50"][i], got["lapse"][i]))


def test_standard_errors_are_those_of_resampling():
    rng = np.random.default_rng(2)
    x, n = np.array([20, 40, 80, 120, 160, 240, 320, 640], float), np.full((400, 8), 800.0)
    k = rng.binomial(800, curves.curve_value(x, 0.03, 110, 0.04, 0.5), (400, 8)) * 1.0
    got = curves.fit_batch(np.tile(x, (400, 1)), n, k)
    for name in ("slope", "x50", "dt75"):
        assert np.nanmedian(got[f"{name}_se"]) == pytest.approx(got[name].std(), rel=0.2)


def test_strata_of_different_cells_are_fitted_together(spark):
    x = {"a": [20.0, 50.0, 100.0, 200.0, 400.0], "b": [10.0, 20.0, 40.0], None: [5.0]}
    rows = [(g, v, i < int(200 * curves.curve_value(np.float64(v), 0.05, 60, 0.0, 0.5))) for g, values in x.items() for v in values for i in range(200)]
    got = {r["g"]: r for r in curves.fit_psychometric(spark.createDataFrame(rows, "g string, x double, correct boolean"), "x", ["g"]).collect()}
    alone = curves.fit_cells(np.array(x["a"]), np.full(5, 200), np.array([sum(c for g, w, c in rows if g == "a" and w == v) for v in x["a"]]))
    assert set(got) == {"a", "b", None} and got["a"]["n"] == 1000
    assert got["a"]["x50"] == pytest.approx(alone["x50"]) and got["a"]["dt75_se"] == pytest.approx(alone["dt75_se"])


@pytest.mark.parametrize("parts", [1, 5])
def test_resampled_crossings(spark, parts):
    rng = np.random.default_rng(6)
    x, n = np.array([20, 40, 80, 160, 320]), 300
    k = [150, 180, 220, 260, 285]
    df = spark.createDataFrame([(int(a), i < b) for a, b in zip(x, k) for i in range(n)], "x int, correct boolean")
    got = curves.bootstrap_curve_threshold(df, "x", 75.0, 800, 3, parts).first()
    share = np.concatenate([k, n - np.array(k)]) / (5 * n)
    drawn = rng.multinomial(5 * n, share, 3000).reshape(-1, 2, 5)
    want = np.array([curves.crossing(x.astype(float), 100.0 * d[0] / d.sum(axis=0), 75.0) for d in drawn])
    assert got["n_valid"] == 800
    for name, q in (("low", 0.025), ("median", 0.5), ("high", 0.975)):
        assert got[name] == pytest.approx(np.nanquantile(want, q), rel=0.06)


def test_crossings_of_continuous_x_need_no_table_on_the_driver(spark):
    df = spark.range(20_000).selectExpr("rand(1) AS x", "rand(2) < 0.5 AS correct")  # every x once: right or wrong
    row = curves.bootstrap_curve_threshold(df, "x", 50.0, 50).first()
    assert row["n_valid"] == 50 and 0 <= row["low"] <= row["high"] <= 1


# ---------------------------------------------------------------------------- filters


def recursion(x, sections, state):
    """Sections sample by sample, as the difference equation says."""
    for (b0, b1, b2, a1, a2), (p, q) in zip(sections, state):
        out = []
        for v in x:
            y = b0 * v + p
            p, q = b1 * v - a1 * y + q, b2 * v - a2 * y
            out.append(y)
        x = out
    return np.array(x)


@pytest.mark.parametrize("kind", ["telephony", "lowpass", "highpass"])
@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_sections_have_the_filters_gain(kind, order):
    sections = variants.butterworth_sections(16000, kind, order=order)
    f = np.array([50.0, 299.0, 300.0, 1000.0, 3400.0, 3600.0, 7000.0])
    z = np.exp(2j * np.pi * f / 16000)
    gain = np.ones(len(f), complex)
    for b0, b1, b2, a1, a2 in sections:
        gain *= (b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2)
        assert abs(np.roots([1, a1, a2])).max() < 1
    assert abs(gain) ** 2 == pytest.approx(variants.butterworth_response(f, 16000, kind, order=order), abs=1e-9)


def test_blocks_equal_the_difference_equation():
    rng = np.random.default_rng(1)
    sections = variants.butterworth_sections(16000, "telephony")
    impulse = np.zeros((1, 200))
    impulse[0, 1] = 1.0  # the first sample is 0, so the settled state is 0 too
    want = recursion(impulse[0], sections, [(0.0, 0.0)] * 4)
    assert variants.run_sections(impulse, sections)[0] == pytest.approx(want, abs=1e-12) and want[0] == 0 and want[1] == pytest.approx(np.prod(sections[:, 0]))
    x = rng.normal(size=(3, 777))
    x[:, 0] = 0.0
    for row, got in zip(x, variants.run_sections(x, sections, 50)):
        assert got == pytest.approx(recursion(row, sections, [(0.0, 0.0)] * 4), abs=1e-10)


def test_a_constant_has_settled_from_the_start():
    low = variants.band_filter(np.full((2, 300), 2.5), 16000, "lowpass")
    assert low == pytest.approx(np.full((2, 300), 2.5), abs=1e-9)
    assert variants.band_filter(np.full((1, 300), 2.5), 16000, "highpass") == pytest.approx(np.zeros((1, 300)), abs=1e-9)
    assert variants.band_filter(np.ones((1, 1)), 16000, "lowpass").shape == (1, 1)


def test_filtered_both_ways_a_tone_keeps_its_place():
    t = np.arange(16000) / 16000
    for f, kind in ((1000.0, "telephony"), (3400.0, "lowpass"), (300.0, "highpass")):
        tone = np.sin(2 * np.pi * f * t)[None, :]
        got = variants.band_filter(tone, 16000, kind)[0, 4000:12000]
        gain = variants.butterworth_response(np.array([f]), 16000, kind)[0]
        assert got == pytest.approx(gain * tone[0, 4000:12000], abs=1e-6)


# ---------------------------------------------------------------------------- noise and files


def test_noise_follows_the_effective_part_of_a_container(spark):
    clip = [0.0] * 40 + [0.5, -0.5] * 10 + [0.0] * 40
    df = spark.createDataFrame([(1, clip, 1000), (2, [0.0] * 100, 1000), (3, clip[:99], 1000)], "clip_id int, samples array<double>, sr int")
    got = {r["clip_id"]: r for r in variants.white_noise_clips(df, 20.0, 1, 100, 20).collect()}
    rms = lambda v: float(np.sqrt(np.mean(np.square(v))))
    assert rms(np.array(got[1]["samples"]) - clip) == pytest.approx(0.05, rel=1e-4) and got[1]["snr_db"] == 20 and not got[1]["silent"]
    assert rms(got[2]["samples"]) == pytest.approx(1e-4, rel=1e-4) and got[2]["snr_db"] is None and got[2]["silent"]
    assert got[3]["samples"] is None and got[3]["error"] == "99 samples, 100 expected"
    whole = variants.white_noise_clips(df.filter("clip_id = 1"), 20.0, 1).first()
    assert rms(np.array(whole["samples"]) - clip) == pytest.approx(rms(clip) / 10, rel=1e-4)


def test_types_of_columns_are_declared(spark, tmp_path):
    (tmp_path / "m.csv").write_text("clip_id,duration_ms,snr_db,correct,score,note\n007,20,,true,0.5,1\n8,1000,-5,false,1,x\n")
    df = manifests.read_manifest(spark, f"{tmp_path}/m.csv", types={"note": "string"})
    assert dict(df.dtypes) | {"clip_id": "string"} == dict(df.dtypes) and dict(df.dtypes)["duration_ms"] == "int" and dict(df.dtypes)["snr_db"] == "double"
    assert [tuple(r)[:6] for r in df.orderBy("duration_ms").collect()] == [("007", 20, None, True, 0.5, "1"), ("8", 1000, -5.0, False, 1.0, "x")]
