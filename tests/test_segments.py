"""Segments of long recordings by ranges of bytes, against slices of whole recordings."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.sources import audio


def file_of(x, sr=1000, before=b"", magic=b"RIFF", data_size=None, extensible=False):
    """A 16-bit file of samples (n, channels), with other chunks before the samples."""
    data, channels = x.astype("<i2").tobytes(), x.shape[1]
    fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else 1, channels, sr, 2 * channels * sr, 2 * channels, 16)
    fmt += struct.pack("<HHIH14x", 22, 16, 0, 1) if extensible else b""
    body = before + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data) if data_size is None else data_size) + data
    return magic + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, at, held = np.random.default_rng(3), tmp_path_factory.mktemp("recordings"), {}

    def add(name, n, channels=1, **how):
        held[name] = rng.integers(-30_000, 30_000, (n, channels))
        (at / f"{name}.wav").write_bytes(file_of(held[name], **how))

    add("long", 200_000)
    add("stereo", 5_000, 2, before=b"LIST" + struct.pack("<I", 3) + b"abc\0")  # of odd length, with its pad
    add("large", 4_000, magic=b"RF64", data_size=0xFFFFFFFF, before=b"ds64" + struct.pack("<IQQQI", 28, 0, 8_000, 0, 0))
    add("broken_off", 3_000, data_size=80_000)
    add("extensible", 2_000, extensible=True)
    add("none", 0)
    (at / "text.wav").write_bytes(b"no recording at all")
    (at / "headless.wav").write_bytes(b"RIFF\0\0\0\0WAVEdata\4\0\0\0abcd")
    (at / "empty.wav").write_bytes(b"")
    return f"file://{at}", held


def index_of(spark, folder):
    return audio.index_wav_corpus(spark, folder).withColumn("uri", F.regexp_extract("path", r"([^/]*)\.wav$", 1))


def test_index_reads_headers_only(spark, folder):
    rows = {r["uri"]: r for r in index_of(spark, folder[0]).collect()}
    assert {k for k, r in rows.items() if r["error"]} == {"text", "headless"}
    assert {k: (r["n_samples"], r["channels"]) for k, r in rows.items() if not r["error"]} == {k: x.shape for k, x in folder[1].items()}


def test_segments_equal_slices(spark, folder):
    rng, spans = np.random.default_rng(5), []
    for name, x in folder[1].items():
        length = len(x) / 1000
        spans += [(name, float(a), float(a + b)) for a, b in zip(rng.uniform(0, length, 200), rng.uniform(0, 0.3, 200))]
        spans += [(name, -1.0, 0.5), (name, length - 0.1, length + 9), (name, length + 1, length + 2), (name, 0.4, 0.2), (name, 0.1, 0.1), (name, None, 1.0), (name, 0.0, length)]
    spans += [("absent", 0.0, 1.0), ("text", 0.0, 1.0), ("empty", 0.0, 1.0), (None, 0.0, 1.0)]
    segments = spark.createDataFrame([(i, *s) for i, s in enumerate(spans)], "no long, uri string, start_s double, end_s double")
    clips, missing = audio.read_segments(index_of(spark, folder[0]), segments, task_bytes=20_000)
    got = {r["no"]: r for r in clips.collect()}
    assert {r["no"] for r in missing.collect()} == set(range(len(spans) - 4, len(spans)))
    assert len(got) == len(spans) - 4
    for no, r in got.items():
        name, a, b = spans[no]
        assert (r["uri"], r["start_s"], r["end_s"], r["sr"], r["error"]) == (name, a, b, 1000, None)
        if a is None:
            assert r["samples"] is None
            continue
        x = (folder[1][name].astype(np.float32) / 32768).mean(axis=1)
        np.testing.assert_array_equal(np.float32(r["samples"]), x[max(0, int(np.floor(a * 1000))) : max(0, int(np.floor(b * 1000)))])


def test_same_as_segments_of_arrays(spark, folder):
    from marlstone.operators.intervals import segment_clips

    segments = spark.createDataFrame([("long", 0.25 * i, 0.25 * i + 0.1) for i in range(400)], "uri string, start_s double, end_s double")
    whole = audio.read_wav_corpus(spark, folder[0], min_bytes=0).filter("error is null").withColumn("uri", F.regexp_extract("path", r"([^/]*)\.wav$", 1))
    told = lambda df: sorted((r["start_s"], r["samples"]) for r in df.collect())
    assert told(audio.read_segments(index_of(spark, folder[0]), segments)[0]) == told(segment_clips(whole, segments)[0])


@pytest.mark.parametrize("hot", ["recording", "place"])
def test_a_hot_recording_is_many_tasks(spark, folder, hot):
    place = "id * 0.002D" if hot == "recording" else "5D"
    segments = spark.range(20_000).selectExpr("id", "'long' AS uri", f"{place} AS start_s", f"{place} + 0.01D AS end_s")
    clips, _ = audio.read_segments(index_of(spark, folder[0]), segments, task_bytes=40_000)
    sizes = [r["count"] for r in clips.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) >= 8 and max(sizes) < 6_000


def test_a_lost_file_is_an_error_of_its_segments(spark, folder, tmp_path):
    for name in ("kept", "lost"):
        (tmp_path / f"{name}.wav").write_bytes(file_of(np.ones((100, 1))))
    index = spark.createDataFrame(index_of(spark, f"file://{tmp_path}").collect(), audio.INDEX + ", uri string")
    (tmp_path / "lost.wav").unlink()
    segments = spark.createDataFrame([(n, 0.01 * i, 0.01 * i + 0.01) for n in ("kept", "lost") for i in range(5)], "uri string, start_s double, end_s double")
    rows = audio.read_segments(index, segments)[0].collect()
    assert {(r["uri"], r["samples"] is None, r["error"] is None) for r in rows} == {("kept", False, True), ("lost", True, False)}


def test_no_segments_and_no_recordings(spark, folder, tmp_path):
    none = spark.createDataFrame([], "uri string, start_s double, end_s double")
    clips, missing = audio.read_segments(index_of(spark, folder[0]), none)
    assert clips.count() == missing.count() == 0
    one = spark.createDataFrame([("a", 0.0, 1.0)], none.schema)
    clips, missing = audio.read_segments(index_of(spark, f"file://{tmp_path}"), one)
    assert clips.count() == 0 and missing.count() == 1
