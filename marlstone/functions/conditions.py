"""Experimental conditions of clip variants: parsing, naming and binning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _number(path: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).cast("int")


def parse_condition(path: Column) -> Column:
    """struct(duration_ms, snr_db) from a file name; an SNR may carry either sign, null where absent."""
    return F.struct(_number(path, r"dur(\d+)ms").alias("duration_ms"), _number(path, r"snr([+-]?\d+)dB").alias("snr_db"))


def bucket_from_id(clip_id: Column, path: Column) -> Column:
    """struct(duration, snr) by literal marks, first match wins."""
    duration = F.when(clip_id.contains("200ms"), "200ms").when(clip_id.contains("1000ms"), "1000ms").otherwise("unknown")
    snr = F.lit("unknown")
    for level in ("20", "10", "5", "0"):
        snr = F.when(path.contains(f"_snr+{level}dB") | path.contains(f"_snr{level}_") | path.contains(f"_snr{level}."), f"{level}dB").otherwise(snr)
    return F.struct(duration.alias("duration"), snr.alias("snr"))


def condition_bin(variant_type: Column, duration_ms: Column, snr_db: Column, band: Column, t60_bin: Column) -> Column:
    """Coarse condition for stratifying."""
    duration = F.when(duration_ms <= 100, "dur_short").when(duration_ms <= 500, "dur_medium").otherwise("dur_long")
    snr = F.when(snr_db <= 0, "snr_low").when(snr_db <= 10, "snr_medium").otherwise("snr_high")
    return (
        F.when(variant_type == "duration", duration)
        .when(variant_type == "snr", snr)
        .when(variant_type == "band", F.concat(F.lit("band_"), F.coalesce(band, F.lit("None"))))
        .when(variant_type == "rir", F.concat(F.lit("rir_"), F.coalesce(t60_bin, F.lit("None"))))
        .otherwise("unknown")
    )


def stratum_key(dataset: Column, label: Column, variant_type: Column, condition: Column) -> Column:
    return F.concat_ws("_", dataset, label, variant_type, condition)


def condition_label(variant_type: Column, duration_ms: Column, snr_db: Column, band: Column, t60_bin: Column) -> Column:
    """Name of the one active condition; of both factors where the type is unknown and both are set."""
    whole = lambda c: F.coalesce(c.cast("int"), F.lit(0)).cast("string")
    both = F.when(duration_ms.isNotNull() & snr_db.isNotNull(), F.concat(F.lit("dur_"), whole(duration_ms), F.lit("_snr_"), whole(snr_db))).otherwise("unknown")
    return (
        F.when(variant_type == "duration", F.concat(F.lit("dur_"), whole(duration_ms), F.lit("ms")))
        .when(variant_type == "snr", F.concat(F.lit("snr_"), whole(snr_db), F.lit("dB")))
        .when(variant_type == "band", F.concat(F.lit("filter_"), F.coalesce(band, F.lit("unk"))))
        .when(variant_type == "rir", F.concat(F.lit("reverb_"), F.coalesce(t60_bin, F.lit("unk"))))
        .otherwise(both)
    )


def variant_id(clip_id: Column, duration_ms: Column, snr_db: Column) -> Column:
    return F.format_string("%s_dur%dms_snr%+ddB", clip_id, duration_ms, snr_db)


def t60_bin(t60: Column, edges: tuple[float, ...] = (0.4, 0.8, 1.5)) -> Column:
    """Name of the reverberation bin, lower edge included; null outside."""
    out, low = F.lit(None).cast("string"), 0.0
    bins = []
    for high in edges:
        bins.append((low, high))
        low = high
    for low, high in reversed(bins):
        last = high == edges[-1]
        inside = (t60 >= low) & ((t60 <= high) if last else (t60 < high))
        out = F.when(inside, f"T60_{low:.1f}-{high:.1f}").otherwise(out)
    return out


def rir_in_range(rirs: DataFrame, low: float, high: float, t60_col: str = "t60") -> DataFrame:
    """Impulse responses with a known T60 in the closed range."""
    return rirs.filter(F.col(t60_col).between(low, high))


def clean_baseline(df: DataFrame, duration_ms: int = 1000, snr_db: int | None = None) -> DataFrame:
    """Undegraded rows: by the flag ``is_normal`` where there is one, else by duration (and SNR)."""
    if "is_normal" in df.columns:
        return df.filter("is_normal")
    keep = F.col("duration_ms") == duration_ms
    return df.filter(keep if snr_db is None else keep & (F.col("snr_db") == snr_db))


def curate_categories(df: DataFrame, drop: list[str], keep: list[str], col: str = "category") -> tuple[DataFrame, DataFrame]:
    """Rows outside the dropped categories (those in neither list stay), and rows, removed rows and share removed by category."""
    dropped = F.coalesce(F.col(col).isin(drop), F.lit(False))
    status = F.when(dropped, "dropped").when(F.col(col).isin(keep), "kept").otherwise("uncategorised")
    summary = df.groupBy(F.col(col), status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("status"))
    return df.filter(~dropped), summary.withColumn("share_of_status", F.round(F.col("n") / total, 6))
