"""Joins between runs, manifests, files and noise pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_order, hash_unit, numbered


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def pair_predictions(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two runs, other columns with suffixes _a and _b. ``keys`` have to be unique on either side: ``duplicate_keys`` tells."""
    named = lambda df, s: df.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c not in keys])
    return named(a, "a").join(named(b, "b"), keys)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n of those with more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def pairing_report(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: matched, only_a, only_b, and pairs whose ground truths differ."""
    left = a.select(*keys, F.col("ground_truth").alias("truth_a"), F.lit(1).alias("in_a"))
    right = b.select(*keys, F.col("ground_truth").alias("truth_b"), F.lit(1).alias("in_b"))
    both = left.join(right, keys, "full_outer")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    has_a, has_b = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    return both.agg(count(has_a & has_b).alias("matched"), count(has_a & ~has_b).alias("only_a"), count(~has_a & has_b).alias("only_b"), count(has_a & has_b & (F.col("truth_a") != F.col("truth_b"))).alias("truth_differs"))


def manifest_coverage(manifest: DataFrame, files: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows whose file exists, rows without, and one row of counts and their ratio."""
    there = files.select(key).distinct().withColumn("_there", F.lit(1))
    marked = manifest.join(there, key, "left")
    ratio = marked.agg(F.count(F.lit(1)).alias("n_rows"), F.count("_there").alias("n_found"))
    ratio = ratio.withColumn("ratio", F.coalesce(F.try_divide(F.col("n_found").cast("double"), "n_rows"), F.lit(0.0)))
    return manifest.join(there, key, "left_semi"), manifest.join(there, key, "left_anti"), ratio


def check_coverage(ratio: DataFrame, min_ratio: float) -> None:
    row = ratio.first()
    if row["ratio"] < min_ratio:
        raise ValueError(f"only {row['n_found']} of {row['n_rows']} files exist")


def leakage_audit(df: DataFrame, group: str, split: str) -> tuple[DataFrame, DataFrame]:
    """Per split: groups and rows; and the groups that lie in more than one split, with their splits."""
    sizes = df.groupBy(split).agg(F.countDistinct(group).alias("n_groups"), F.count(F.lit(1)).alias("n_rows"))
    spread = df.groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("splits")).filter(F.size("splits") > 1)
    return sizes, spread.withColumn("splits", F.concat_ws(",", "splits"))


def assign_noise(clips: DataFrame, pool: DataFrame, seed: int = 0, snr_low: float = 0.0, snr_high: float = 20.0, share: float = 1.0, clip_key: str = "clip_id", pool_key: str = "noise_id", type_col: str | None = None) -> DataFrame:
    """Clips with noise_id (of the clip's type, where given), snr_db and applied; picks follow the clip's hash, not the order of rows.

    The pool is numbered by ranges of its key, so it may be of any size.
    """
    by = [type_col] if type_col else []
    members, sizes = numbered(pool.select(*by, pool_key), [pool_key], by, "noise-pool")
    members, sizes = members.withColumnRenamed("_place", "_slot"), sizes.withColumnRenamed("_size", "_n")
    pick = F.floor(hash_unit(clip_key, seed=seed) * F.col("_n")).cast("long")
    rows = clips.join(sizes, by) if by else clips.join(F.broadcast(sizes))
    rows = rows.withColumn("_slot", pick).join(members.select(*by, "_slot", pool_key), [*by, "_slot"])
    snr = F.lit(snr_low) + hash_unit(clip_key, seed=seed + 1) * F.lit(snr_high - snr_low)
    return rows.withColumn("snr_db", snr).withColumn("applied", hash_unit(clip_key, seed=seed + 2) < share).drop("_slot", "_n")


def delta_cells(base: DataFrame, other: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, base, other, delta of a metric by cell; a cell that one side lacks stays null."""
    a = base.select(*keys, F.col(value).alias("base"))
    b = other.select(*keys, F.col(value).alias("other"))
    return a.join(b, keys, "full_outer").withColumn("delta", F.col("other") - F.col("base"))


def compare_thresholds(base: DataFrame, new: DataFrame, key: str = "metric", value: str = "value", lower_is_better: bool = True) -> DataFrame:
    """key, base, new, delta, percent of |base| (0 where base is 0) and improved."""
    both = base.select(key, F.col(value).alias("base")).join(new.select(key, F.col(value).alias("new")), key)
    both = both.withColumn("delta", F.col("new") - F.col("base"))
    percent = F.when(F.col("base") != 0, F.col("delta") / F.abs("base") * 100).otherwise(0.0)
    return both.withColumn("percent", percent).withColumn("improved", (F.col("delta") < 0) if lower_is_better else (F.col("delta") > 0))


def pick_order(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(hash_order(key, seed=seed), key)
