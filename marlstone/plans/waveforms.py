"""Queries of condition grids and waveforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import waves
from ..operators import variants
from ..operators.common import shared_path
from ..sources import audio
from .base import query
from .metrics import rounded
from .roles import role, table


def _waves(spark, d):
    return role(spark, d, "waves")


def _told(df, samples="samples"):
    """A waveform by its size, sum and first and last sample."""
    x = F.col(samples).cast("array<double>")
    return df.withColumn("n_samples", F.size(x)).withColumn("total", F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 5)).withColumn("first", F.round(F.get(x, F.lit(0)), 5)).withColumn("last", F.round(F.try_element_at(x, F.lit(-1)), 5)).drop(samples)


_TOLD = "len(y)::INTEGER AS n_samples, round(list_sum(y), 5) AS total, round(y[1], 5) AS first, round(y[-1], 5) AS last"
_X = "x AS (SELECT vec_id AS clip_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


@query("SELECT p_partkey AS clip_id, dur AS duration_ms, s AS snr_db, concat(p_partkey, '_dur', dur, 'ms_snr', CASE WHEN s >= 0 THEN '+' ELSE '' END, s, 'dB') AS variant_id FROM (SELECT p_partkey, dur, unnest([-10, -5, 0, 5, 10, 20]) AS s FROM (SELECT p_partkey, unnest([20, 40, 60, 80, 100, 200, 500, 1000]) AS dur FROM part))")
def vr01_expand_factorial(spark, d):
    return variants.expand_factorial(table(spark, d, "part").select(F.col("p_partkey").alias("clip_id")))


@query("""WITH g AS (SELECT 'duration' AS variant_type, unnest([20, 40, 60, 80, 100, 200, 500, 1000]) AS duration_ms, NULL::INTEGER AS snr_db, NULL::STRING AS band_filter, NULL::DOUBLE AS t60, NULL::STRING AS t60_bin UNION ALL SELECT 'snr', NULL, unnest([-10, -5, 0, 5, 10, 20]), NULL, NULL, NULL
 UNION ALL SELECT 'band', NULL, NULL, unnest(['telephony', 'lowpass', 'highpass']), NULL, NULL UNION ALL SELECT 'rir', NULL, NULL, NULL, t, b FROM (VALUES (0.3, 'T60_0.0-0.4'), (0.6, 'T60_0.4-0.8'), (1.2, 'T60_0.8-1.5')) v(t, b))
SELECT p_partkey AS clip_id, g.*, coalesce(duration_ms = 1000, FALSE) AS is_normal, concat(p_partkey, '_', variant_type, '_', CASE variant_type WHEN 'duration' THEN concat('dur', duration_ms, 'ms') WHEN 'snr' THEN concat('snr', CASE WHEN snr_db >= 0 THEN '+' ELSE '' END, snr_db, 'dB') WHEN 'band' THEN band_filter ELSE t60_bin END) AS variant_id FROM part, g""")
def vr02_expand_one_factor(spark, d):
    return variants.expand_one_factor(table(spark, d, "part").select(F.col("p_partkey").alias("clip_id")))


@query(f"WITH {_X} SELECT clip_id, round(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 6) AS rms, round(list_max(list_transform(x, lambda v: abs(v))), 6) AS peak, len(x)::INTEGER AS n_samples, 64.0::DOUBLE AS duration_ms FROM x")
def vr03_wave_stats(spark, d):
    return rounded(_waves(spark, d).select("clip_id", waves.wave_stats(F.col("samples"), F.col("sr")).alias("s")).select("clip_id", "s.*"))


@query(f"WITH {_X}, t AS (SELECT clip_id, list_transform(x, lambda v: greatest(least(v * (0.95::DOUBLE / list_max(list_transform(x, lambda u: abs(u)))), 1), -1)) AS y FROM x) SELECT clip_id, {_TOLD} FROM t")
def vr04_peak_normalize(spark, d):
    return _told(_waves(spark, d).select("clip_id", waves.peak_normalize(F.col("samples")).alias("samples")))


@query(f"WITH {_X}, r AS (SELECT *, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) AS m FROM x), t AS (SELECT clip_id, list_transform(x, lambda v: v * (0.1::DOUBLE / m)) AS y FROM r) SELECT clip_id, {_TOLD} FROM t")
def vr05_rms_normalize(spark, d):
    return _told(_waves(spark, d).select("clip_id", waves.rms_normalize(F.col("samples")).alias("samples")))


@query(f"WITH {_X}, t AS (SELECT clip_id, x[23:42] AS y FROM x) SELECT clip_id, {_TOLD} FROM t")
def vr06_center_slice(spark, d):
    return _told(_waves(spark, d).select("clip_id", waves.center_slice(F.col("samples"), 20, F.col("sr")).alias("samples")))


@query(f"WITH {_X}, s AS (SELECT *, CAST(floor(CAST(concat('0x', substr(md5(concat_ws('|', CAST(clip_id AS STRING), '5')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE * 45) AS INTEGER) AS k FROM x), t AS (SELECT clip_id, x[k + 1:k + 20] AS y FROM s) SELECT clip_id, {_TOLD} FROM t")
def vr07_random_slice(spark, d):
    return _told(_waves(spark, d).select("clip_id", waves.random_slice(F.col("samples"), 20, F.col("sr"), F.col("clip_id"), 5).alias("samples")))


@query("SELECT vec_id AS clip_id, 101 AS n_samples, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total, 0.0::DOUBLE AS first, 0.0::DOUBLE AS last, round(CAST(embedding[1] AS DOUBLE), 5) AS at_left FROM embeddings")
def vr08_pad_center(spark, d):
    w = _waves(spark, d).select("clip_id", waves.pad_center(F.col("samples"), 101, F.col("sr")).alias("samples"))
    return _told(w.withColumn("at_left", F.round(F.col("samples")[18], 5)))


@query(f"""WITH {_X}, p AS (SELECT a.clip_id, a.x, b.x AS z FROM x a JOIN x b ON b.clip_id = 0), g AS (SELECT *, sqrt(list_sum(list_transform(x, lambda v: v * v)) / 64 / (10.0::DOUBLE * (list_sum(list_transform(z, lambda v: v * v)) / 64) + 0.0000000001::DOUBLE)) AS gain FROM p),
t AS (SELECT clip_id, list_transform(range(1, 65), lambda i: x[i] + z[i] * gain) AS y FROM g) SELECT clip_id, {_TOLD} FROM t""")
def vr10_mix_noise(spark, d):
    w = _waves(spark, d)
    noise = w.filter("clip_id = 0").select(F.col("samples").alias("noise"))
    return _told(w.join(F.broadcast(noise)).select("clip_id", waves.mix_noise(F.col("samples"), F.col("noise"), F.lit(10.0)).alias("samples")))


@query()
def vr14_render_variants(spark, d):
    """White noise (VR9), Butterworth bands (VR11), reverberation (VR12, VR13) and padding on every clip."""
    r = variants.render_variants(_waves(spark, d), container_ms=128)
    return rounded(_told(r), 5)


@query()
def vr15_noise_for_clips(spark, d):
    """A noise clip of hashed colour for every waveform, mixed at 10 dB."""
    w = _waves(spark, d)
    n = w.count()
    noise = variants.noise_corpus(spark, n, {("white", -20.0): 0.4, ("pink", -20.0): 0.3, ("brown", -30.0): 0.3}, 1000, 64)
    mixed = w.join(noise.withColumnRenamed("samples", "noise"), w["clip_id"] == noise["noise_id"])
    return _told(mixed.select("clip_id", "colour", "level_db", waves.mix_noise(F.col("samples"), F.col("noise"), F.lit(10.0)).alias("samples")))


@query(f"""WITH {_X.replace("AS clip_id", "AS track_id").replace("FROM embeddings", "FROM embeddings WHERE label < 5")}, s AS (SELECT *, unnest([0, 1]) AS segment_no FROM x),
k AS (SELECT *, CAST(floor(CAST(concat('0x', substr(md5(concat_ws('|', concat_ws('_', CAST(track_id AS STRING), CAST(segment_no AS STRING)), '0')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE * 39) AS INTEGER) AS k FROM s),
t AS (SELECT track_id, segment_no, x[5 + k + 1:5 + k + 16] AS y FROM k), f AS (SELECT * FROM t WHERE sqrt(list_sum(list_transform(y, lambda v: v * v)) / 16) >= 0.01 ORDER BY md5(concat_ws('|', CAST(track_id AS STRING), CAST(segment_no AS STRING), '0')), track_id, segment_no LIMIT 200)
SELECT track_id, segment_no, {_TOLD} FROM f""")
def vr16_extract_segments(spark, d):
    w = _waves(spark, d).withColumnRenamed("clip_id", "track_id")
    tracks = w.select("track_id", F.expr("CASE WHEN label < 5 THEN 'classical' ELSE 'talk' END").alias("genre"))
    return _told(variants.extract_segments(w, tracks, ["classical"], 16, 200, 2, 0.005))


@query(f"WITH {_X} SELECT clip_id, 10.0::DOUBLE AS snr_db, 10.0::DOUBLE AS measured_db, FALSE AS silent, len(x)::INTEGER AS n_samples FROM x")
def vr09_add_white_noise(spark, d):
    """The noise is what the clip has gained; its level is exact for each clip."""
    w = _waves(spark, d)
    noisy = variants.white_noise_clips(w, 10.0, 3).withColumnRenamed("samples", "noisy").join(w.select("clip_id", "samples"), "clip_id")
    gained = F.zip_with(F.col("noisy").cast("array<double>"), F.col("samples").cast("array<double>"), lambda a, b: a - b)
    measured = 20 * F.log10(waves.rms(F.col("samples")) / waves.rms(gained))
    return noisy.select("clip_id", "snr_db", F.round(measured, 3).alias("measured_db"), "silent", F.size("noisy").alias("n_samples"))


@query(f"WITH {_X} SELECT clip_id, CASE WHEN clip_id % 5 = 0 THEN NULL ELSE 10.0::DOUBLE END AS snr_db, CASE WHEN clip_id % 5 = 0 THEN NULL ELSE 10.0::DOUBLE END AS measured_db, CASE WHEN clip_id % 5 = 0 THEN NULL ELSE FALSE END AS silent, CASE WHEN clip_id % 5 = 0 THEN NULL ELSE 100 END AS n_samples, CASE WHEN clip_id % 5 = 0 THEN '64 samples, 100 expected' END AS error FROM x")
def vr09_noise_in_container(spark, d):
    """Clips of 64 ms in the middle of 100 ms, every fifth one left short: the level of the noise over the whole container follows the clip's part of it."""
    w = _waves(spark, d)
    held = w.withColumn("samples", F.when(F.col("clip_id") % 5 == 0, F.col("samples").cast("array<double>")).otherwise(waves.pad_center(F.col("samples"), 100, F.col("sr"))))
    noisy = variants.white_noise_clips(held, 10.0, 3, 100, 64).withColumnRenamed("samples", "noisy").join(held.select("clip_id", "samples"), "clip_id")
    gained = F.zip_with(F.col("noisy").cast("array<double>"), F.col("samples"), lambda a, b: a - b)
    measured = 20 * F.log10(waves.rms(F.slice("samples", F.lit(19), F.lit(64))) / waves.rms(gained))
    return noisy.select("clip_id", "snr_db", F.round(F.when(F.col("error").isNull(), measured), 3).alias("measured_db"), "silent", F.when(F.col("error").isNull(), F.size("noisy")).alias("n_samples"), "error")


@query()
def vr11_band_filter(spark, d):
    return _told(variants.band_filtered_clips(_waves(spark, d), "telephony", 60.0, 300.0))


@query(f"WITH {_X} SELECT clip_id, len(x)::INTEGER AS n_samples, round(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 5) AS rms FROM x")
def vr13_apply_rir(spark, d):
    """Convolved with a synthetic response of 0.3 s (VR12): as long and as loud as before."""
    return variants.reverberated_clips(_waves(spark, d), 0.3).select("clip_id", F.size("samples").alias("n_samples"), F.round(waves.rms(F.col("samples")), 5).alias("rms"))


@query("SELECT vec_id AS clip_id, 101 AS n_samples, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total_of_clip, TRUE AS faint FROM embeddings")
def vr08_pad_with_noise(spark, d):
    """The clip lies in the middle; around it is noise of a ten-thousandth."""
    x = F.col("samples").cast("array<double>")
    w = variants.noise_padded_clips(_waves(spark, d), 101)
    edges = F.concat(F.slice(x, 1, 18), F.slice(x, 83, 19))
    total = F.round(F.aggregate(F.slice(x, 19, 64), F.lit(0.0), lambda a, v: a + v), 5)
    return w.select("clip_id", F.size("samples").alias("n_samples"), total.alias("total_of_clip"), ((waves.peak(edges) < 0.001) & (waves.peak(edges) > 0)).alias("faint"))


_GRID27 = ([20, 40, 60, 80, 100, *range(200, 1001, 100)], [-10, -5, 0, 5, 10, 15, 20], ["telephony", "lp3400", "hp300"], {"T60_0.0-0.4": 0.2, "T60_0.4-0.8": 0.6, "T60_0.8-1.5": 1.1})


@query("""WITH g AS (SELECT 'duration' AS variant_type, unnest([20, 40, 60, 80, 100, 200, 300, 400, 500, 600, 700, 800, 900, 1000]) AS duration_ms, NULL::INTEGER AS snr_db, NULL::STRING AS band_filter, NULL::DOUBLE AS t60, NULL::STRING AS t60_bin UNION ALL SELECT 'snr', NULL, unnest([-10, -5, 0, 5, 10, 15, 20]), NULL, NULL, NULL
 UNION ALL SELECT 'band', NULL, NULL, unnest(['telephony', 'lp3400', 'hp300']), NULL, NULL UNION ALL SELECT 'rir', NULL, NULL, NULL, t, b FROM (VALUES (0.2, 'T60_0.0-0.4'), (0.6, 'T60_0.4-0.8'), (1.1, 'T60_0.8-1.5')) v(t, b))
SELECT p_partkey AS clip_id, g.*, coalesce(duration_ms = 1000, FALSE) AS is_normal, concat(p_partkey, '_', variant_type, '_', CASE variant_type WHEN 'duration' THEN concat('dur', duration_ms, 'ms') WHEN 'snr' THEN concat('snr', CASE WHEN snr_db >= 0 THEN '+' ELSE '' END, snr_db, 'dB') WHEN 'band' THEN band_filter ELSE t60_bin END) AS variant_id FROM part, g""")
def vr02_expand_one_factor_27(spark, d):
    """The longer grid: 14 durations, 7 ratios, 3 bands, 3 reverberations."""
    return variants.expand_one_factor(table(spark, d, "part").select(F.col("p_partkey").alias("clip_id")), variants.one_factor_grid(*_GRID27))


@query(f"WITH {_X} SELECT clip_id, 1000 AS sr, len(x)::INTEGER AS n_samples, round(list_sum(list_transform(x, lambda v: trunc(greatest(least(v, 1), -1) * 32767) / 32768)), 4) AS total, NULL::STRING AS error FROM x")
def io11_read_wav_corpus(spark, d):
    """Every vector as a WAV file, written and read back: 16 bits a sample."""
    folder = shared_path(spark, "wav")
    audio.write_wav_corpus(_waves(spark, d), folder)
    rows = audio.read_wav_corpus(spark, folder, min_bytes=44)
    clip = F.regexp_extract("path", r"([^/]*)\.wav$", 1).cast("long")
    total = F.aggregate(F.col("samples").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    return rows.select(clip.alias("clip_id"), "sr", F.size("samples").alias("n_samples"), F.round(total, 4).alias("total"), "error")


_QC = f"{_X}, q AS (SELECT clip_id, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) AS rms, list_max(list_transform(x, lambda v: abs(v))) AS peak FROM x)"


@query(f"WITH {_QC} SELECT clip_id, 1000 AS sr, round(rms, 6) AS rms, round(peak, 6) AS peak, CASE WHEN peak < 0.1 THEN 'duration_mismatch,low_peak' ELSE 'duration_mismatch' END AS issues, FALSE AS ok FROM q")
def vr17_audio_qc(spark, d):
    return rounded(variants.audio_qc(_waves(spark, d), 1000, 100).withColumn("issues", F.array_join("issues", ",")))


@query(f"WITH {_QC} SELECT count(*) AS n, 1.0::DOUBLE AS ok_share, " + ", ".join(f"round(quantile_cont({c}, {p}), 6) AS {c}_q{int(100 * p)}" for c in ("rms", "peak") for p in (0.25, 0.5, 0.75)) + " FROM q")
def vr18_audio_qc_summary(spark, d):
    return rounded(variants.audio_qc_summary(variants.audio_qc(_waves(spark, d), 1000, 64)))


@query(f"WITH {_QC}, i AS (SELECT unnest(CASE WHEN peak < 0.1 THEN ['duration_mismatch', 'low_peak'] ELSE ['duration_mismatch'] END) AS issue FROM q) SELECT issue, count(*) AS n FROM i GROUP BY 1")
def vr18_audio_qc_issues(spark, d):
    return variants.audio_qc_issues(variants.audio_qc(_waves(spark, d), 1000, 100))


@query(f"WITH {_QC}, r AS (SELECT *, row_number() OVER (ORDER BY rms DESC, clip_id) AS a, row_number() OVER (ORDER BY rms, clip_id) AS b FROM q) SELECT 'top' AS end, clip_id, round(rms, 6) AS rms FROM r WHERE a <= 5 UNION ALL SELECT 'bottom', clip_id, round(rms, 6) FROM r WHERE b <= 5".replace("AS end,", 'AS "end",'))
def vr18_audio_qc_extremes(spark, d):
    return rounded(variants.audio_qc_extremes(variants.audio_qc(_waves(spark, d), 1000, 64)))
