"""Scalar expressions on the reference cases and on awkward values."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import answers, conditions, labels, scores, waves

# Expected labels of free answers.
CASES = [
    ("I hear someone talking", "SPEECH"), ("There's a human voice", "SPEECH"), ("Sounds like speech", "SPEECH"), ("A person is speaking", "SPEECH"),
    ("Human conversation", "SPEECH"), ("Spoken words", "SPEECH"), ("Vocal sounds", "SPEECH"), ("Laughter.", "SPEECH"),
    ("I heard laughter and the sound of water splashing.", "SPEECH"), ("There is a background noise followed by laughter.", "SPEECH"), ("I heard giggling", "SPEECH"),
    ("I hear music", "NONSPEECH"), ("It's just noise", "NONSPEECH"), ("Silence", "NONSPEECH"), ("Background noise", "NONSPEECH"), ("Beeping sounds", "NONSPEECH"),
    ("Musical instrument", "NONSPEECH"), ("Clock ticking", "NONSPEECH"), ("I heard an engine accelerating and revving", "NONSPEECH"),
    ("The sound is that of an engine idling loudly.", "NONSPEECH"), ("I heard the sound of a motor vehicle on the road", "NONSPEECH"), ("It's a sound effect.", "NONSPEECH"),
    ("No, there is no human speech in this audio.", "NONSPEECH"), ("No, the transcription is empty indicating no speech content.", "NONSPEECH"),
    ("SPEECH", "SPEECH"), ("NON-SPEECH", "NONSPEECH"), ("A) SPEECH", "SPEECH"), ("B", None), ("I don't know", None), ("Unclear", None),
]


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("r")).first()["r"]


def test_normalize_response_cases(spark):
    df = spark.createDataFrame(CASES, "text string, want string")
    for r in df.select("text", "want", answers.normalize_response(F.col("text"))["label"].alias("got")).collect():
        assert r["got"] == r["want"], r["text"]


@pytest.mark.parametrize("text,label,confidence", [("", None, 0.0), (None, None, 0.0), ("yes", "SPEECH", 0.95), ("Sí", "SPEECH", 0.95), ("not true", None, 0.0), ("absent", "NONSPEECH", 0.95), ("voice over music", "SPEECH", 0.6), ("using a tool", "SPEECH", 0.8), ("NO\nSPEECH", "SPEECH", 1.0), (" noise ", "NONSPEECH", 0.8)])
def test_normalize_response_steps(spark, text, label, confidence):
    r = one(spark, answers.normalize_response(F.col("t")), t=text) if text is not None else spark.sql("select cast(null as string) t").select(answers.normalize_response(F.col("t")).alias("r")).first()["r"]
    assert r["label"] == label and r["confidence"] == pytest.approx(confidence)


def test_normalize_response_options(spark):
    mapping = F.create_map(F.lit("A"), F.lit("SPEECH"), F.lit("B"), F.lit("NONSPEECH"))
    probs = F.create_map(F.lit("B"), F.lit(0.7))
    r = one(spark, answers.normalize_response(F.col("t"), F.lit(0.5), mapping, letter_probs=probs), t="b) maybe")
    assert (r["label"], r["confidence"]) == ("NONSPEECH", 0.7)
    r = one(spark, answers.normalize_response(F.col("t"), F.lit(0.5), mapping), t="A")
    assert (r["label"], r["confidence"]) == ("SPEECH", 0.5)
    assert one(spark, answers.normalize_response(F.col("t"), verbalizers=("YES",)), t="speech")["confidence"] == pytest.approx(0.8)


@pytest.mark.parametrize("text,label,confidence", [("A", "SPEECH", 1.0), ("b)", "NONSPEECH", 1.0), ("Non-Speech", "NONSPEECH", 1.0), ("music", "NONSPEECH", 0.9), ("It isn't speech", "NONSPEECH", 0.9), ("speech!", "SPEECH", 1.0), ("no", "NONSPEECH", 0.8), ("Yes", "SPEECH", 0.8), ("hm", "UNKNOWN", 0.0)])
def test_parse_response(spark, text, label, confidence):
    r = one(spark, answers.parse_response(F.col("t")), t=text)
    assert (r["label"], r["confidence"]) == (label, confidence)


def test_prompts(spark):
    clean = lambda t, o=False: one(spark, answers.clean_prompt(F.col("t"), o), t=t)
    assert clean("  Say SPEECH\n or NON-SPEECH ")["text"] == "Say SPEECH or NON-SPEECH"
    assert [clean(t)["reason"] for t in ("x", "speech " * 60, "what do you hear?", "<|AUDIO|> speech here")] == ["too short", "too long", "missing labels", "forbidden token"]
    assert clean("what do you hear?", True)["valid"] and not clean("tell me a story", True)["valid"]
    fmt = lambda t: one(spark, answers.detect_prompt_format(F.col("t")), t=t)
    assert [fmt(t) for t in ("a) x b) y", "a) d)", "option a option b", "speech nonspeech", "?")] == ["ab", "mc", "ab", "labels", "open"]


def test_ids_and_conditions(spark):
    base = lambda t: one(spark, labels.base_clip_id(F.col("t")), t=t)
    assert [base(t) for t in ("voxconverse_abc_42.1_1000ms", "1-68734-A-34_1000ms_075", "1-5-C_200ms_1", "esc50_x_3_1000ms", "plain")] == ["voxconverse_abc", "1-68734-A-34", "1-5-C", "esc50_x_3_1000ms", "plain"]
    c = one(spark, conditions.parse_condition(F.col("t")), t="/a/x_dur80ms_snr+10dB.wav")
    assert (c["duration_ms"], c["snr_db"]) == (80, 10)
    c = one(spark, conditions.parse_condition(F.col("t")), t="/a/x_snr-5dB")
    assert (c["duration_ms"], c["snr_db"]) == (None, -5)
    assert one(spark, conditions.variant_id(F.lit("c"), F.lit(20), F.lit(0)), t="") == "c_dur20ms_snr+0dB"
    assert one(spark, labels.clip_id_of_path(F.col("t")), t="/a/b.c/d.e.wav") == "d.e"
    assert [one(spark, conditions.t60_bin(F.lit(x)), t="") for x in (0.0, 0.4, 1.5, 1.6)] == ["T60_0.0-0.4", "T60_0.4-0.8", "T60_0.8-1.5", None]


def test_scores(spark):
    p = lambda m, raw="": one(spark, scores.speech_prob(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.lit(raw)), t="")
    assert p({"Speech": 0.6, "nonspeech": 0.2}) == pytest.approx(0.75)
    assert p({"noise": 0.3}) == pytest.approx(0.7) and p({"x": 1.0}, "non-speech") == 0.1 and p({"x": 1.0}, "speech") == 0.9
    s = one(spark, scores.logit_scores(F.lit(2.0), F.lit(0.0), 2.0), t="")
    assert s["prob_a"] == pytest.approx(0.7310586) and s["prediction"] == "SPEECH"


def test_waves(spark):
    df = spark.createDataFrame([([0.1, -0.2, 0.4, 0.0],)], "samples array<float>")
    first = lambda c: df.select(c.alias("r")).first()["r"]
    x, sr = F.col("samples"), F.lit(1000)
    assert first(waves.center_slice(x, 2, sr)) == pytest.approx([-0.2, 0.4], abs=1e-6)
    assert first(waves.pad_center(x, 7, sr)) == pytest.approx([0, 0.1, -0.2, 0.4, 0, 0, 0], abs=1e-6)
    assert max(first(waves.peak_normalize(x))) == pytest.approx(0.95)
    assert first(waves.rms(waves.rms_normalize(x))) == pytest.approx(0.1)
    assert len(first(waves.random_slice(x, 6, sr, F.lit("k")))) == 6
    assert first(waves.audio_issues(x, sr, 16000, 4)) == ["sr_mismatch"]
    mixed = first(waves.mix_noise(x, F.array(F.lit(1.0), F.lit(-1.0)), F.lit(0.0)))
    noise = [a - b for a, b in zip(mixed, [0.1, -0.2, 0.4, 0.0])]
    assert sum(v * v for v in noise) / 4 == pytest.approx((0.01 + 0.04 + 0.16) / 4, rel=1e-4)
