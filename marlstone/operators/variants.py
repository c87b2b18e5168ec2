"""Variants of base clips: condition grids, rendering and corpora of noise.

Waveforms are rendered in vectorised batches; a clip's waveform is carried once and all of its variants
are made where it lies. Noise is seeded by the variant's id.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import waves
from ..functions.conditions import variant_id
from .common import first_by_hash, quantiles, written

DURATIONS = [20, 40, 60, 80, 100, 200, 500, 1000]
SNRS = [-10, -5, 0, 5, 10, 20]
BANDS = ["telephony", "lowpass", "highpass"]
REVERBS = {"T60_0.0-0.4": 0.3, "T60_0.4-0.8": 0.6, "T60_0.8-1.5": 1.2}
GRID = "struct<variant_type: string, duration_ms: int, snr_db: int, band_filter: string, t60: double, t60_bin: string, is_normal: boolean>"


def expand_factorial(clips: DataFrame, durations: list[int] = DURATIONS, snrs: list[int] = SNRS) -> DataFrame:
    """clip x duration x SNR, with variant_id."""
    rows = clips.drop("duration_ms", "snr_db")
    rows = rows.withColumn("duration_ms", F.explode(F.array(*[F.lit(d) for d in durations]))).withColumn("snr_db", F.explode(F.array(*[F.lit(s) for s in snrs])))
    return rows.withColumn("variant_id", variant_id(F.col("clip_id").cast("string"), F.col("duration_ms"), F.col("snr_db")))


def one_factor_grid(durations: list[int] = DURATIONS, snrs: list[int] = SNRS, bands: list[str] = BANDS, reverbs: dict[str, float] | None = None) -> list[tuple]:
    reverbs = REVERBS if reverbs is None else reverbs
    return [
        *[("duration", d, None, None, None, None, d == 1000) for d in durations],
        *[("snr", None, s, None, None, None, False) for s in snrs],
        *[("band", None, None, b, None, None, False) for b in bands],
        *[("rir", None, None, None, t, name, False) for name, t in reverbs.items()],
    ]


def expand_one_factor(clips: DataFrame, grid: list[tuple] | None = None) -> DataFrame:
    """clip x grid: one condition active at a time, the others null, with is_normal and variant_id."""
    kinds = [k.split(": ") for k in GRID.removeprefix("struct<").removesuffix(">").split(", ")]
    cell = lambda row: F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, kinds)])
    rows = clips.drop(*[k for k, _ in kinds]).withColumn("_g", F.explode(F.array(*[cell(r) for r in grid or one_factor_grid()]))).select("*", "_g.*").drop("_g")
    tag = F.when(F.col("variant_type") == "duration", F.concat(F.lit("dur"), F.col("duration_ms").cast("string"), F.lit("ms"))).when(F.col("variant_type") == "snr", F.format_string("snr%+ddB", "snr_db")).when(F.col("variant_type") == "band", F.col("band_filter")).otherwise(F.col("t60_bin"))
    return rows.withColumn("variant_id", F.concat_ws("_", F.col("clip_id").cast("string"), "variant_type", tag))


# ---------------------------------------------------------------------------- batch helpers


def rng_of(key: str, seed: int) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.md5(f"{key}|{seed}".encode()).digest()[:8], "little"))


def add_white_noise(x: np.ndarray, snr_db: float, start: int, end: int, rng: np.random.Generator) -> tuple[np.ndarray, float | None, bool]:
    """(samples, snr_db or None, silent): noise over all samples, its level exact for the RMS of the part [start, end)."""
    level = float(np.sqrt(np.mean(np.square(x[start:end], dtype=np.float64)))) if end > start else 0.0
    silent = level < 1e-8
    target = 1e-4 if silent else level / 10 ** (snr_db / 20)
    noise = rng.standard_normal(len(x))
    noise *= target / max(float(np.sqrt(np.mean(noise**2))), 1e-300)
    return x + noise, None if silent else snr_db, silent


def butterworth_response(freqs: np.ndarray, sr: int, kind: str, low: float = 300.0, high: float = 3400.0, order: int = 4) -> np.ndarray:
    """|H|^2 at each frequency of the zero-phase filter: the digital Butterworth's gain, forward and backward. "telephony" is one band-pass, not two filters in a row."""
    warp = lambda f: np.tan(np.pi * np.minimum(f, sr / 2 * 0.999999) / sr)
    w, w1, w2 = np.maximum(warp(freqs), 1e-12), warp(np.float64(low)), warp(np.float64(high))
    if kind == "lowpass":
        x = w / w2
    elif kind == "highpass":
        x = w1 / w
    else:
        x = (w * w - w1 * w2) / (w * (w2 - w1))
    return 1 / (1 + x ** (2 * order))


def butterworth_sections(sr: int, kind: str, low: float = 300.0, high: float = 3400.0, order: int = 4) -> np.ndarray:
    """(b0, b1, b2, a1, a2) of each second-order section of the digital Butterworth filter, with gain 1 in its band.

    The analog poles lie on a half circle; they are moved to the band at warped edges and mapped by the bilinear transform.
    """
    warp = lambda f: np.tan(np.pi * min(f, sr / 2 * 0.999999) / sr)
    w1, w2 = warp(low), warp(high)
    circle = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    if kind == "lowpass":
        poles, zeros, at = circle * w2, (-1.0, -1.0), 1.0 + 0j
    elif kind == "highpass":
        poles, zeros, at = w1 / circle, (1.0, 1.0), -1.0 + 0j
    else:
        half = circle * (w2 - w1) / 2
        root = np.sqrt(half * half - w1 * w2 + 0j)
        poles, zeros = np.concatenate([half + root, half - root]), (1.0, -1.0)
        at = np.exp(2j * np.arctan(np.sqrt(w1 * w2)))
    poles = (1 + poles) / (1 - poles)
    pairs = [(p, p.conjugate()) for p in poles[poles.imag > 1e-12]]
    real = sorted(poles[abs(poles.imag) <= 1e-12].real)
    pairs += list(zip(real[::2], real[1::2]))
    sections = [([1.0, -sum(zeros), zeros[0] * zeros[1]], [-(p + q).real, (p * q).real]) for p, q in pairs]
    if len(real) % 2:  # an odd order has one pole of its own
        sections.append(([1.0, -zeros[0], 0.0], [-real[-1], 0.0]))
    out = []
    for b, a in sections:
        gain = abs((b[0] + b[1] / at + b[2] / at**2) / (1 + a[0] / at + a[1] / at**2))
        out.append([*(v / gain for v in b), *a])
    return np.array(out)


def run_sections(batch: np.ndarray, sections: np.ndarray, block: int = 64) -> np.ndarray:
    """Rows of samples through sections in a row, from the state in which a constant at the first sample would have settled.

    A section has two numbers of state. Of a block of samples, output and next state are matrices times the state before and the samples.
    """
    n = batch.shape[1]
    out = np.concatenate([batch, np.zeros((len(batch), -n % block))], axis=1)
    level = batch[:, :1].copy()
    for b0, b1, b2, a1, a2 in sections:
        step, drive = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
        powers = [np.eye(2)]
        for _ in range(block):
            powers.append(step @ powers[-1])
        seen = np.array([p[0] for p in powers[:block]])  # output i, by the state
        impulse = np.array([b0, *[p[0] @ drive for p in powers[: block - 1]]])
        place = np.subtract.outer(np.arange(block), np.arange(block))
        reach = np.where(place >= 0, impulse[np.abs(place)], 0.0)  # output i, by sample j
        gather = np.array([powers[block - 1 - j] @ drive for j in range(block)]).T  # the next state, by sample j
        state = level * np.linalg.solve(np.eye(2) - step, drive)
        level = level * (b0 + b1 + b2) / (1 + a1 + a2)
        for at in range(0, out.shape[1], block):
            x = out[:, at : at + block].copy()
            out[:, at : at + block] = state @ seen.T + x @ reach.T
            state = state @ powers[block].T + x @ gather.T
    return out[:, :n]


def band_filter(batch: np.ndarray, sr: int, kind: str, low: float = 300.0, high: float = 3400.0, order: int = 4) -> np.ndarray:
    """Filters rows of samples forward and backward, so without a shift; ends are padded by odd reflection."""
    sections = butterworth_sections(sr, kind, low, high, order)
    n = batch.shape[1]
    pad = min(3 * (2 * len(sections) + 1 - int((sections[:, 2] == 0).sum())), max(0, n - 1))
    left, right = 2 * batch[:, :1] - batch[:, pad:0:-1], 2 * batch[:, -1:] - batch[:, -2 : -pad - 2 : -1]
    padded = np.concatenate([left, batch, right], axis=1) if pad else batch
    for _ in range(2):
        padded = run_sections(padded, sections)[:, ::-1]
    return padded[:, pad : pad + n]


def synthetic_rir(t60: float, sr: int, seed: int = 0) -> np.ndarray:
    """Decaying noise with peak 1; a single impulse below 10 ms."""
    if t60 <= 0.01:
        return np.ones(1)
    n = max(1, int(t60 * sr))
    out = rng_of(f"rir{t60}", seed).standard_normal(n) * np.exp(-3 * np.log(10) / t60 * np.arange(n) / sr)
    return out / np.abs(out).max()


def apply_rir(batch: np.ndarray, rir: np.ndarray) -> np.ndarray:
    """Rows of samples convolved with an impulse response, cut to their length, at their former RMS."""
    n = batch.shape[1]
    size = 1 << int(np.ceil(np.log2(n + len(rir) - 1)))
    wet = np.fft.irfft(np.fft.rfft(batch, size, axis=1) * np.fft.rfft(rir, size), size, axis=1)[:, :n]
    before, after = (np.sqrt(np.mean(a**2, axis=1, keepdims=True)) for a in (batch, wet))
    return np.where(after > 1e-8, wet * before / np.maximum(after, 1e-300), wet)


def coloured_noise(n: int, colour: str, rng: np.random.Generator) -> np.ndarray:
    """White, pink (1/f) or brown (1/f^2) noise with peak 1."""
    spectrum = np.fft.rfft(rng.standard_normal(n))
    f = np.maximum(np.arange(len(spectrum)), 1)
    out = np.fft.irfft(spectrum / {"white": 1, "pink": np.sqrt(f), "brown": f}[colour], n)
    return out / max(float(np.abs(out).max()), 1e-300)


def pad_low_noise(x: np.ndarray, total: int, rng: np.random.Generator, sigma: float = 1e-4) -> np.ndarray:
    """Centre of a container of faint noise; longer input is cut."""
    if len(x) >= total:
        return x[:total]
    out = rng.standard_normal(total) * sigma
    left = (total - len(x)) // 2
    out[left : left + len(x)] = x
    return out


def _by_length(batch):
    """(positions, samples as rows of a matrix, sample rate) of the clips of a pandas batch, clips of one length and rate together."""
    sizes = [(len(x) if x is not None else 0, int(sr)) for x, sr in zip(batch["samples"], batch["sr"])]
    for size in sorted(set(sizes)):
        at = [i for i, s in enumerate(sizes) if s == size]
        yield at, np.array([np.asarray(batch["samples"].iloc[i], np.float64) for i in at]).reshape(len(at), size[0]), size[1]


def _each(clips: DataFrame, extra: str, change) -> DataFrame:
    """Clips with new samples and columns ``extra``; change(ids, matrix, sr) gives a matrix and, in order, those columns."""
    names = [e.split()[0] for e in extra.split(", ")] if extra else []

    def run(batches):
        import pandas as pd

        for batch in batches:
            for at, x, sr in _by_length(batch):
                ids = batch["clip_id"].iloc[at].tolist()
                y, *columns = change(ids, x, sr) if x.size else (x, *[[None] * len(at) for _ in names])
                yield pd.DataFrame({"clip_id": ids, "samples": list(y.astype(np.float32)), **dict(zip(names, columns))})

    kind = dict(clips.dtypes)["clip_id"]
    return clips.select("clip_id", "samples", "sr").mapInPandas(run, f"clip_id {kind}, samples array<float>" + (f", {extra}" if extra else ""))


def white_noise_clips(clips: DataFrame, snr_db: float, seed: int = 0, container_ms: int | None = None, effective_ms: float | None = None) -> DataFrame:
    """clip_id, samples with white noise at that ratio to the RMS of the clip's effective part, snr_db (null where that is silent), silent.

    The noise lies over the whole container, the effective part is ``effective_ms`` in its middle, or all of it. With ``container_ms`` there is
    a column error, and clips of another length have no samples. Noise follows the id and the seed.
    """

    def change(ids, x, sr):
        n, want = x.shape[1], None if container_ms is None else int(sr * container_ms / 1000)
        if want is not None and n != want:
            nothing = [None] * len(ids)
            return x, nothing, nothing, [f"{n} samples, {want} expected"] * len(ids)
        size = n if effective_ms is None else int(sr * effective_ms / 1000)
        start = (n - size) // 2
        out = [add_white_noise(row, snr_db, max(start, 0), start + size, rng_of(f"{i}_noise", seed)) for i, row in zip(ids, x)]
        return np.array([o[0] for o in out]), [o[1] for o in out], [bool(o[2]) for o in out], [None] * len(ids)

    rows = _each(clips, "snr_db double, silent boolean, error string", change)
    if container_ms is None:
        return rows.drop("error")
    return rows.withColumn("samples", F.when(F.col("error").isNull(), F.col("samples")))


def band_filtered_clips(clips: DataFrame, kind: str, low: float = 300.0, high: float = 3400.0, order: int = 4) -> DataFrame:
    """clip_id, samples after a zero-phase Butterworth filter: telephony (band-pass), lowpass or highpass."""
    return _each(clips, "", lambda ids, x, sr: (band_filter(x, sr, kind, low, high, order),))


def reverberated_clips(clips: DataFrame, t60: float, seed: int = 0) -> DataFrame:
    """clip_id, samples convolved with a synthetic impulse response, as long and as loud as before."""
    return _each(clips, "", lambda ids, x, sr: (apply_rir(x, synthetic_rir(t60, sr, seed)),))


def noise_padded_clips(clips: DataFrame, container_ms: int, sigma: float = 1e-4, seed: int = 0) -> DataFrame:
    """clip_id, samples in the middle of a container of faint noise; longer clips are cut."""
    return _each(clips, "", lambda ids, x, sr: (np.array([pad_low_noise(row, container_ms * sr // 1000, rng_of(f"{i}_pad", seed), sigma) for i, row in zip(ids, x)]),))


def render_variants(clips: DataFrame, grid: list[tuple] | None = None, container_ms: int = 2000, seed: int = 0) -> DataFrame:
    """clip_id, variant_id, the condition columns, rms, silent and samples of every variant.

    clips: clip_id, samples, sr. Short durations are the middle of the clip in a container of faint noise. Clips of a batch
    that have one length and rate are a matrix, and each cell of the grid is worked out for all of them at once; an
    impulse response is made once for each rate. Noise follows the clip's id and the cell.
    """
    cells = grid or one_factor_grid()

    def tag(cell: tuple) -> str:
        kind, duration, snr, band, _, name, _ = cell
        return {"duration": f"dur{duration}ms", "snr": f"snr{snr or 0:+d}dB", "band": band, "rir": name}[kind]

    def contained(x: np.ndarray, total: int, keys: list[str]) -> tuple[np.ndarray, int]:
        """Rows in the middle of containers of faint noise, and where they begin."""
        n = x.shape[1]
        if n >= total:
            return x[:, :total].copy(), 0
        out = np.array([rng_of(k, seed).standard_normal(total) for k in keys]).reshape(len(keys), total) * 1e-4
        left = (total - n) // 2
        out[:, left : left + n] = x
        return out, left

    def rendered(x: np.ndarray, sr: int, cell: tuple, keys: list[str], rirs: dict) -> tuple[np.ndarray, np.ndarray]:
        kind, duration, snr, band, t60, _, _ = cell
        total, silent = container_ms * sr // 1000, np.zeros(len(keys), bool)
        if kind == "duration":
            t = int(duration * sr / 1000)
            at = (x.shape[1] - t) // 2
            x = x[:, at : at + t] if x.shape[1] > t else x
        elif kind == "band":
            x = band_filter(x, sr, band)
        elif kind == "rir":
            if (t60, sr) not in rirs:
                rirs[t60, sr] = synthetic_rir(t60, sr, seed)
            x = apply_rir(x, rirs[t60, sr])
        y, left = contained(x, total, keys)
        if kind == "snr":
            part = y[:, left : left + min(x.shape[1], total)]
            level = np.sqrt(np.mean(part**2, axis=1)) if part.shape[1] else np.zeros(len(keys))
            silent = level < 1e-8
            noise = np.array([rng_of(f"{k}_noise", seed).standard_normal(total) for k in keys]).reshape(len(keys), total)
            target = np.where(silent, 1e-4, level / 10 ** (snr / 20))
            y = y + noise * (target / np.maximum(np.sqrt(np.mean(noise**2, axis=1)), 1e-300))[:, None]
        return np.clip(y, -1, 1), silent

    def render(batches):
        import pandas as pd

        names = ["variant_type", "duration_ms", "snr_db", "band_filter", "t60", "t60_bin"]
        rirs: dict = {}
        for batch in batches:
            for at, x, sr in _by_length(batch):
                ids = batch["clip_id"].iloc[at].tolist()
                for cell in cells if x.size else ():
                    keys = [f"{clip}_{cell[0]}_{tag(cell)}" for clip in ids]
                    y, silent = rendered(x, sr, cell, keys, rirs)
                    out = pd.DataFrame({"clip_id": ids, "variant_id": keys, **{n: [v] * len(ids) for n, v in zip(names, cell)}})
                    out["rms"], out["silent"] = np.sqrt(np.mean(y**2, axis=1)), silent
                    out["samples"] = list(y.astype(np.float32))
                    yield out.astype({"duration_ms": "Int32", "snr_db": "Int32", "t60": "Float64"})

    kind = dict(clips.dtypes)["clip_id"]
    schema = f"clip_id {kind}, variant_id string, variant_type string, duration_ms int, snr_db int, band_filter string, t60 double, t60_bin string, rms double, silent boolean, samples array<float>"
    return clips.select("clip_id", "samples", "sr").mapInPandas(render, schema)


def noise_corpus(spark, n: int, mix: dict[tuple[str, float], float], sr: int = 16000, ms: int = 1000, seed: int = 0) -> DataFrame:
    """noise_id, colour, level_db, samples: int(n * share) clips of each (colour, level), the rest of the first."""
    quota = {k: int(n * share) for k, share in mix.items()}
    first = next(iter(quota))
    quota[first] += n - sum(quota.values())
    limits, upto = [], 0
    for (colour, level), k in quota.items():
        limits.append((upto, upto + k, colour, level))
        upto += k

    def make(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for i in batch["id"]:
                colour, level = next((c, v) for a, b, c, v in limits if a <= i < b)
                x = coloured_noise(sr * ms // 1000, colour, rng_of(f"noise{i}", seed)) * 10 ** (level / 20)
                rows.append((i, colour, level, x.astype(np.float32)))
            yield pd.DataFrame(rows, columns=["noise_id", "colour", "level_db", "samples"])

    return spark.range(n).mapInPandas(make, "noise_id long, colour string, level_db double, samples array<float>")


def extract_segments(waveforms: DataFrame, tracks: DataFrame, genres: list[str], ms: int, total: int, per_track: int = 2, margin_s: float = 5.0, least_rms: float = 0.01, seed: int = 0) -> DataFrame:
    """track_id, segment_no, samples: up to ``per_track`` hashed segments of tracks of allowed genres, away from the ends, loud enough, ``total`` at most."""
    rows = waveforms.join(tracks.filter(F.col("genre").isin(genres)).select("track_id", "genre"), "track_id")
    n, t = F.size("samples"), F.floor(F.lit(ms) * F.col("sr") / 1000).cast("int")
    rows = rows.filter(n >= 2 * t).withColumn("segment_no", F.explode(F.sequence(F.lit(0), F.lit(per_track - 1))))
    margin = F.least(F.floor(F.lit(margin_s) * F.col("sr")).cast("int"), F.floor((n - t) / 2).cast("int"))
    inner = F.slice("samples", margin + 1, n - 2 * margin)
    rows = rows.withColumn("samples", waves.random_slice(inner, F.lit(ms), F.col("sr"), F.concat_ws("_", F.col("track_id").cast("string"), F.col("segment_no").cast("string")), seed))
    rows = rows.filter(waves.rms(F.col("samples")) >= least_rms).select("track_id", "segment_no", "samples")
    return first_by_hash(written(rows, "segments"), total, ["track_id", "segment_no"], seed)


def audio_qc(clips: DataFrame, expected_sr: int, expected_ms: float, key: str = "clip_id") -> DataFrame:
    """key, rms, peak, issues, ok."""
    error = F.col("error") if "error" in clips.columns else None
    issues = waves.audio_issues(F.col("samples"), F.col("sr"), expected_sr, expected_ms, error)
    return clips.select(key, "sr", waves.rms(F.col("samples")).alias("rms"), waves.peak(F.col("samples")).alias("peak"), issues.alias("issues")).withColumn("ok", F.size("issues") == 0)


def audio_qc_issues(qc: DataFrame) -> DataFrame:
    return qc.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "issue")


def audio_qc_summary(qc: DataFrame, accuracy: int | None = None) -> DataFrame:
    """One row: n, share without issues, quartiles of rms and peak: exact, by narrowing ranges of values, or by percentile_approx with ``accuracy``."""
    shares = {c: {f"{c}_q{int(100 * p)}": p for p in (0.25, 0.5, 0.75)} for c in ("rms", "peak")}
    counts = [F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("int")).alias("ok_share")]
    if accuracy is not None:
        return qc.agg(*counts, *[F.percentile_approx(c, p, accuracy).alias(name) for c, wanted in shares.items() for name, p in wanted.items()])
    out = qc.agg(*counts)
    for c, wanted in shares.items():
        out = out.join(F.broadcast(quantiles(qc, [], c, wanted)), F.lit(True), "left")  # one row each
    return out


def audio_qc_extremes(qc: DataFrame, k: int = 5, key: str = "clip_id") -> DataFrame:
    """The ``k`` loudest and the ``k`` softest clips by rms."""
    loud = qc.orderBy(F.desc("rms"), key).limit(k).withColumn("end", F.lit("top"))
    return loud.unionByName(qc.orderBy("rms", key).limit(k).withColumn("end", F.lit("bottom"))).select("end", key, "rms")
