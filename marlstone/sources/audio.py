"""WAV corpora."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "path string, samples array<float>, sr int, error string"


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Mono float samples in [-1, 1] of 16-bit PCM; channels are averaged."""
    import io
    import wave

    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2:
            raise ValueError(f"{8 * w.getsampwidth()}-bit samples")
        data = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
        return (data.astype(np.float32) / 32768).mean(axis=1), w.getframerate()


def encode_wav(samples: np.ndarray, sr: int) -> bytes:
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(sr)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def encode_clips(clips: DataFrame) -> DataFrame:
    """path (clip_id.wav) and content of clips (clip_id, samples, sr): 16-bit mono files as rows."""

    def encode(batches):
        import pandas as pd

        for batch in batches:
            content = [encode_wav(np.asarray(x, np.float64), int(sr)) for x, sr in zip(batch["samples"], batch["sr"])]
            yield pd.DataFrame({"path": batch["clip_id"].astype(str) + ".wav", "content": content})

    return clips.select("clip_id", "samples", "sr").mapInPandas(encode, "path string, content binary")


def write_wav_corpus(clips: DataFrame, folder: str) -> None:
    """A file <clip_id>.wav for each clip below ``folder``, through Arrow's file systems. Files that a lost attempt left are written again alike."""
    files = encode_clips(clips)

    def write(batches):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with system.open_output_stream(f"{inner}/{path}") as f:
                    f.write(content)
            yield batch[["path"]]

    files.mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()


def decode_files(files: DataFrame) -> DataFrame:
    """path, samples, sr, error of rows (path, content); a file that cannot be read becomes a row with its error."""

    def decode(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    samples, sr = decode_wav(content)
                    rows.append((path, samples, sr, None))
                except Exception as e:  # the error is the row's content
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "samples", "sr", "error"]).astype({"sr": "Int32"})

    return files.select("path", "content").mapInPandas(decode, SCHEMA)


def read_wav_corpus(spark: SparkSession, folder: str, min_bytes: int = 1024, pattern: str = "*.wav") -> DataFrame:
    """All WAV files below a folder, smaller ones than ``min_bytes`` left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return decode_files(files.filter(F.col("length") >= min_bytes))


# ---------------------------------------------------------------------------- segments of long recordings

INDEX = "path string, sr int, channels int, data_at long, n_samples long, error string"
READ_BYTES = 32 << 20


def wav_shape(read, size: int) -> tuple[int, int, int, int]:
    """Sample rate, channels, place of the first sample and number of samples, from the chunk headers alone.

    ``read(at, n)`` gives n bytes of a file of ``size`` bytes. Files of over 4 GB have their sizes in a ds64 chunk; a data chunk that is
    longer than the file, as in a recording that was broken off, ends with the file.
    """
    head = read(0, 12)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise ValueError("no RIFF file of waves")
    at, shape, long_data = 12, None, None
    while at + 8 <= size:
        name, n = struct.unpack("<4sI", read(at, 8))
        if name == b"ds64":
            long_data = struct.unpack("<Q", read(at + 16, 8))[0]
        elif name == b"fmt ":
            code, channels, sr, _, _, bits = struct.unpack("<HHIIHH", read(at + 8, 16))
            if code == 0xFFFE:  # extensible: the code is the sub-format's first half-word
                code = struct.unpack("<H", read(at + 32, 2))[0]
            if code != 1 or bits != 16 or not channels:
                raise ValueError(f"{bits}-bit samples of format {code} in {channels} channels")
            shape = sr, channels
        elif name == b"data":
            if shape is None:
                raise ValueError("samples before their format")
            n = long_data if n == 0xFFFFFFFF and long_data is not None else n
            return *shape, at + 8, max(0, min(n, size - at - 8)) // (2 * shape[1])
        at += 8 + n + n % 2
    raise ValueError("no samples")


def index_wav_corpus(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """path, sr, channels, data_at, n_samples, error: a row a file below a folder, of which only the chunk headers are read. Files of no bytes have no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")

    def shapes(batches):
        import pandas as pd
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path, size in zip(batch["path"], batch["length"]):
                try:
                    system, inner = fs.FileSystem.from_uri(path)
                    with system.open_input_file(inner) as f:
                        rows.append((path, *wav_shape(lambda at, n: f.read_at(n, at), size), None))
                except Exception as e:  # the error is the row's content
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "sr", "channels", "data_at", "n_samples", "error"]).astype({"sr": "Int32", "channels": "Int32", "data_at": "Int64", "n_samples": "Int64"})

    return files.mapInPandas(shapes, INDEX)


def _sample(t: str) -> Column:
    return F.least(F.greatest(F.floor(F.col(t) * F.col("_sr")).cast("long"), F.lit(0).cast("long")), F.col("_n"))


def read_segments(index: DataFrame, segments: DataFrame, key: str = "uri", task_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """Segments (key, start_s, end_s and others) with samples, sr and error, and the segments whose recording is missing or unreadable.

    ``index`` is index_wav_corpus's, with ``key`` beside it, unique. A segment is the samples from floor(start_s * sr) to floor(end_s * sr), cut to
    the recording, channels averaged. Segments are dealt by recording and place, so that a recording of any length is read by many
    tasks and each reads near places one after another; a task looks for ``task_bytes`` of samples and holds one batch of segments at a
    time. No recording is ever a row. Where a bound is null, so are the samples; a read that fails is that segment's error.
    ``segments`` has no columns sr, samples or error of its own.
    """
    named = index.filter("error is null").select(F.col(key), *[F.col(c).alias(f"_{n}") for c, n in (("path", "path"), ("sr", "sr"), ("channels", "channels"), ("data_at", "data_at"), ("n_samples", "n"))])
    found = segments.join(named, key)
    known = F.col("start_s").isNotNull() & F.col("end_s").isNotNull()  # greatest and least pass over nulls
    found = found.withColumn("_first", F.when(known, _sample("start_s"))).withColumn("_count", F.when(known, F.greatest(_sample("end_s") - F.col("_first"), F.lit(0).cast("long"))))
    total = found.agg(F.sum(F.col("_count") * F.col("_channels") * 2)).first()[0] or 0
    order = ["_path", "_first", "_count"]
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in segments.columns])  # equal places, as of a hot segment, are many tasks' work too
    dealt = found.repartitionByRange(int(min(1 + total // task_bytes, 100_000)), *order, spread).sortWithinPartitions(*order)
    kept, names = [*segments.columns, "_sr"], [*segments.columns, "sr", "samples", "error"]

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        path, f = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(c) for c in ("_path", "_channels", "_data_at", "_first", "_count")}
            places = list(zip(*(c.to_pylist() for c in columns.values())))
            size, begin, samples, errors = 0, 0, [], []
            for i, (name, channels, data_at, first, count) in enumerate(places):
                error, x = None, None
                try:
                    if name != path:
                        if f is not None:
                            f.close()
                        path, f = None, None
                        system, inner = fs.FileSystem.from_uri(name)
                        f, path = system.open_input_file(inner), name
                    if first is not None and count is not None:
                        data = f.read_at(2 * channels * count, data_at + 2 * channels * first)
                        x = (np.frombuffer(data, "<i2").reshape(count, channels).astype(np.float32) / 32768).mean(axis=1)
                except Exception as e:  # the error is the row's content
                    error = f"{type(e).__name__}: {e}"
                samples.append(x)
                errors.append(error)
                size += 0 if x is None else x.nbytes
                if size >= READ_BYTES or i + 1 == len(places):
                    own = [batch.column(c).slice(begin, i + 1 - begin) for c in kept]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(samples, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=names)
                    size, begin, samples, errors = 0, i + 1, [], []
        if f is not None:
            f.close()

    types = T.StructType([*segments.schema.fields, T.StructField("sr", T.IntegerType()), T.StructField("samples", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])
    return dealt.mapInArrow(read, types), segments.join(named.select(key), key, "left_anti")
