"""Waveforms - arrays of samples - as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.common import hash_unit


def _d(samples: Column) -> Column:
    return samples.cast("array<double>")


def rms(samples: Column) -> Column:
    n = F.nullif(F.size(samples), F.lit(0))
    return F.coalesce(F.sqrt(F.aggregate(_d(samples), F.lit(0.0), lambda a, x: a + x * x) / n), F.lit(0.0))


def peak(samples: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(_d(samples), F.abs)), F.lit(0.0))


def wave_stats(samples: Column, sr: Column) -> Column:
    """struct(rms, peak, n_samples, duration_ms)."""
    n = F.size(samples)
    return F.struct(rms(samples).alias("rms"), peak(samples).alias("peak"), n.alias("n_samples"), (n * 1000.0 / sr).alias("duration_ms"))


def _scaled(samples: Column, gain: Column, clip: bool) -> Column:
    return F.transform(_d(samples), (lambda x: F.greatest(F.least(x * gain, F.lit(1.0)), F.lit(-1.0))) if clip else (lambda x: x * gain))


def peak_normalize(samples: Column, target: float = 0.95, headroom_db: float = 0.0, clip: bool = True) -> Column:
    """Peak to target less the headroom; silent clips stay."""
    top = peak(samples)
    return F.when(top < 1e-6, _d(samples)).otherwise(_scaled(samples, F.lit(target * 10 ** (-headroom_db / 20)) / top, clip))


def rms_normalize(samples: Column, target: float = 0.1, least: float = 1e-8, clip: bool = False) -> Column:
    level = rms(samples)
    return F.when(level <= least, _d(samples)).otherwise(_scaled(samples, F.lit(target) / level, clip))


def _count(ms: Column | float, sr: Column) -> Column:
    return F.floor(F.lit(ms) * sr / 1000 if not isinstance(ms, Column) else ms * sr / 1000).cast("int")


def center_slice(samples: Column, ms: Column | float, sr: Column) -> Column:
    """The middle; all of a clip that is too short."""
    n, t = F.size(samples), _count(ms, sr)
    return F.when(n <= t, samples).otherwise(F.slice(samples, F.floor((n - t) / 2).cast("int") + 1, t))


def zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0.0), F.greatest(n, F.lit(0)))


def random_slice(samples: Column, ms: Column | float, sr: Column, key: Column, seed: int = 0) -> Column:
    """A part whose start follows the key's hash; a short clip is padded with zeros at its end."""
    n, t = F.size(samples), _count(ms, sr)
    start = F.floor(hash_unit(key, seed=seed) * (n - t + 1)).cast("int")
    return F.when(n >= t, F.slice(_d(samples), start + 1, t)).otherwise(F.concat(_d(samples), zeros(t - n)))


def pad_center(samples: Column, ms: Column | float, sr: Column) -> Column:
    """Zeros around, the left side rounded down; a longer clip is cut at its end."""
    n, t = F.size(samples), _count(ms, sr)
    left = F.floor((t - n) / 2).cast("int")
    return F.when(n >= t, F.slice(_d(samples), F.lit(1), t)).otherwise(F.concat(zeros(left), _d(samples), zeros(t - n - left)))


def mix_noise(samples: Column, noise: Column, snr_db: Column) -> Column:
    """Noise repeated or cut to the clip's length, scaled to the SNR by power, and added."""
    n = F.size(samples)
    times = F.ceil(n / F.greatest(F.size(noise), F.lit(1))).cast("int")
    fitted = F.slice(F.flatten(F.array_repeat(_d(noise), times)), F.lit(1), n)
    power = lambda a: F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x) / F.size(a)
    gain = F.sqrt(power(samples) / (F.pow(F.lit(10.0), snr_db / 10) * power(fitted) + F.lit(1e-10)))
    return F.zip_with(_d(samples), fitted, lambda x, y: x + y * gain)


def audio_issues(samples: Column, sr: Column, expected_sr: int, expected_ms: float, error: Column | None = None) -> Column:
    """Array of issue names."""
    x = _d(samples)
    n = F.size(samples)
    off = F.abs(n * 1000.0 / sr - F.lit(expected_ms)) > 10
    clipped = F.size(F.filter(x, lambda v: F.abs(v) >= 0.999)) / F.greatest(n, F.lit(1)) > 0.01
    nan, inf = F.exists(x, F.isnan), F.exists(x, lambda v: F.abs(v) == float("inf"))
    found = [("sr_mismatch", sr != expected_sr), ("duration_mismatch", off), ("nan", nan), ("inf", inf), ("silent", rms(samples) < 1e-6), ("clipping", clipped), ("low_peak", peak(samples) < 0.1)]
    issues = [F.when(c, name) for name, c in found]
    if error is not None:
        issues = [F.when(error.isNotNull(), "load_error"), *[F.when(error.isNull(), i) for i in issues]]
    return F.array_compact(F.array(*issues))
