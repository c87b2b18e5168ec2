"""Leak-free splits, balanced samples and compositions.

Random choices follow a seeded hash of the id, so they do not depend on partitioning. Group splits are
drawn on the distinct groups and joined back.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import first_by_hash, hash_order


def _placed(df: DataFrame, keys: list[str], id_col: str, seed: int) -> DataFrame:
    """Adds _place, the rank by hash order within equal ``keys`` (null is a value), and _size, how many rows those have.

    Ranks are taken inside 256 ranges of the hash, after the sizes of the ranges before, so a key may hold most rows.
    """
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.lit(0)
    rows = df.withColumn("_key", key).withColumn("_order", hash_order(id_col, seed=seed)).withColumn("_range", F.substring("_order", 1, 2))
    sizes = rows.groupBy("_key", "_range").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_key")  # 256 rows a key
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_key", "_range", before.alias("_start"), F.sum("_n").over(whole).alias("_size"))
    within = F.row_number().over(Window.partitionBy("_key", "_range").orderBy("_order", id_col))
    ranked = rows.withColumn("_within", within).join(starts, ["_key", "_range"])
    return ranked.withColumn("_place", F.col("_start") + F.col("_within")).drop("_key", "_range", "_order", "_within", "_start")


def balance_to_min(df: DataFrame, keys: list[str], id_col: str, seed: int = 0) -> DataFrame:
    """Every group of ``keys`` cut to the size of the smallest, by hash order; rows with a null key are dropped."""
    rows = df.dropna(subset=keys)
    least = rows.groupBy(*keys).count().agg(F.min("count").alias("_least"))
    ranked = _placed(rows, keys, id_col, seed)
    return ranked.join(F.broadcast(least)).filter("_place <= _least").drop("_place", "_size", "_least")  # one row


def split_clips_stratified(df: DataFrame, test_size: float, seed: int = 0, clip_col: str = "clip_id", strata: list[str] | None = None) -> DataFrame:
    """Adds split (dev or test): per stratum max(1, int(n * test_size)) clips are tested; all rows of a clip go together."""
    strata = strata or ["dataset", "ground_truth"]
    clips = df.groupBy(clip_col).agg(*[F.min(c).alias(c) for c in strata])
    n_test = F.greatest(F.lit(1), F.floor(F.col("_size") * F.lit(test_size)).cast("int"))
    clips = _placed(clips, strata, clip_col, seed).withColumn("split", F.when(F.col("_place") <= n_test, "test").otherwise("dev"))
    return df.join(clips.select(clip_col, "split"), clip_col)


def majority_label(df: DataFrame, group: str, label: str) -> DataFrame:
    """group, label: its most frequent label, alphabetically first of equals."""
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), label))
    return counts.withColumn("_place", first).filter("_place = 1").select(group, label)


def split_groups_by_majority(df: DataFrame, test_size: float, seed: int = 0, group: str = "group_id", label: str = "ground_truth") -> DataFrame:
    """Adds split (train or test): ceil(test_size * groups) of each majority label are tested."""
    groups = majority_label(df, group, label)
    n_test = F.ceil(F.lit(test_size) * F.col("_size"))
    groups = _placed(groups, [label], group, seed).withColumn("split", F.when(F.col("_place") <= n_test, "test").otherwise("train"))
    return df.join(groups.select(group, "split"), group)


def split_groups(df: DataFrame, sizes: dict[str, float | int], seed: int = 0, group: str = "group_id") -> DataFrame:
    """Adds split, exclusive by group. ``sizes``: shares, or numbers of groups, of the splits in order; the last may be None for the rest."""
    groups = df.select(group).distinct()
    n = groups.count()
    counts, left = {}, n
    for name, size in sizes.items():
        want = left if size is None else size if isinstance(size, int) else int(n * size)
        if want > left:
            raise ValueError(f"{n} groups do not suffice for {sizes}")
        counts[name], left = want, left - want
    upto, chain = 0, F.lit(None).cast("string")
    steps = []
    for name, count in counts.items():
        upto += count
        steps.append((upto, name))
    for limit, name in reversed(steps):
        chain = F.when(F.col("_place") <= limit, name).otherwise(chain)
    return df.join(_placed(groups, [], group, seed).withColumn("split", chain).filter("split is not null").drop("_place", "_size"), group)


def apportioned(sizes: DataFrame, keys: list[str], seats: int, total: int, seed: int = 0) -> DataFrame:
    """keys, _seats: ``seats`` of ``total`` dealt to groups (keys, _size) by their size; what rounding down leaves goes to the largest remainders.

    Of equal remainders the first by hash of the keys. Remainders are whole numbers (size * seats mod total), ranked inside 64 ranges of
    them by 256 of the hash, after the sizes of the ranges before, so there may be any number of groups.
    """
    rows = sizes.withColumn("_exact", F.col("_size").cast("decimal(38,0)") * F.lit(seats).cast("decimal(19,0)"))
    rows = rows.withColumn("_seats", F.expr(f"_exact div {total}")).withColumn("_rest", F.expr(f"_exact % {total}").cast("long")).withColumn("_order", hash_order(*keys, seed=seed))
    high = (F.lit(63) - F.floor(F.lit(64.0) * F.col("_rest") / total)).cast("string")
    rows = rows.withColumn("_range", F.concat(F.lpad(high, 2, "0"), F.substring("_order", 1, 2)))
    left = rows.agg((F.lit(seats) - F.sum("_seats")).alias("_left"))  # one row
    ranges = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    start = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 16,384 rows
    within = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc("_rest"), "_order", *keys))
    rows = rows.withColumn("_within", within).join(ranges.select("_range", start.alias("_start")), "_range").join(F.broadcast(left))
    more = F.col("_start") + F.col("_within") <= F.col("_left")
    return rows.select(*keys, (F.col("_seats") + more.cast("long")).alias("_seats"))


def split_rows_stratified(df: DataFrame, strata: list[str], fallback: list[str], test_size: float, seed: int = 0, id_col: str = "clip_id") -> DataFrame:
    """Adds split (train or test) row by row. ceil(n * test_size) rows are tested; the others are dealt to the strata by largest remainders.

    By ``fallback`` alone where a stratum has one row, or there are more strata than rows of a side.
    """
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_size"))
    least, n, groups = sizes.agg(F.min("_size"), F.coalesce(F.sum("_size"), F.lit(0)), F.count(F.lit(1))).first()
    n_test = math.ceil(n * test_size)
    by = strata
    if not n or least < 2 or groups > min(n_test, n - n_test):
        by, sizes = fallback, df.groupBy(*fallback).agg(F.count(F.lit(1)).alias("_size"))
    seats = apportioned(sizes, by, n - n_test, max(n, 1), seed)
    rows = _placed(df, by, id_col, seed)
    joined = rows.alias("r").join(seats.alias("s"), reduce(and_, [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]))
    split = F.when(F.col("_place") <= F.col("_size") - F.col("_seats"), "test").otherwise("train")
    return joined.select("r.*", "s._seats").withColumn("split", split).drop("_place", "_size", "_seats")


def split_rows_random(df: DataFrame, share: float, seed: int = 0, id_col: str = "clip_id") -> DataFrame:
    """Adds split: round(share * N) rows train, the rest test."""
    n = round(df.count() * share)
    return _placed(df, [], id_col, seed).withColumn("split", F.when(F.col("_place") <= n, "train").otherwise("test")).drop("_place", "_size")


def split_balanced_ratios(df: DataFrame, train: float, dev: float, seed: int = 0, label: str = "ground_truth", id_col: str = "clip_id", cap: int | None = None) -> DataFrame:
    """Adds split after cutting both classes to the smaller one (and ``cap``): int(n * train), int(n * dev), rest test."""
    least = df.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    n = least if cap is None else min(least, cap)
    place = F.col("_place")
    split = F.when(place <= int(n * train), "train").when(place <= int(n * train) + int(n * dev), "dev").otherwise("test")
    return _placed(df, [label], id_col, seed).filter(place <= n).withColumn("split", split).drop("_place", "_size")


def sample_uniform(df: DataFrame, n: int, seed: int = 0, id_col: str = "clip_id") -> DataFrame:
    """``n`` rows: the first by hash order, taken by a cut through the hashes, so n may be half of the table."""
    return first_by_hash(df, n, [id_col], seed)


def sample_stratified(df: DataFrame, n: int, label: str = "ground_truth", seed: int = 0, id_col: str = "clip_id") -> DataFrame:
    """Each class in its share of ``n`` (at least 1, half to even, at most its size), then ``n`` rows at most."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))  # one row
    rows = _placed(df.dropna(subset=[label]), [label], id_col, seed).join(F.broadcast(total))
    share = F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("_size") / F.col("_total")).cast("int"))
    return sample_uniform(rows.filter(F.col("_place") <= share).drop("_place", "_size", "_total"), n, seed, id_col)


def sample_per_condition(df: DataFrame, keys: list[str], k: int, n: int, seed: int = 0, id_col: str = "clip_id") -> DataFrame:
    """At most ``k`` rows of each bucket - null is a bucket value - then ``n`` at most."""
    rows = _placed(df, keys, id_col, seed).filter(F.col("_place") <= k).drop("_place", "_size")
    return sample_uniform(rows, n, seed, id_col)


def sample_half_half(df: DataFrame, n: int, label: str = "ground_truth", seed: int = 0, id_col: str = "clip_id") -> DataFrame:
    """n // 2 rows of each class (none for n < 2); drawn with replacement where the class is too small. Adds draw, the number of the draw."""
    half = n // 2
    ranked = _placed(df, [label], id_col, seed).drop("_size").withColumn("_place", F.col("_place") - 1)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(half - 1)) if half > 0 else F.array().cast("array<int>")))
    again = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", label, "draw", F.lit(str(seed)))), 1, 8), 16, 10).cast("long"), F.col("_n"))
    draws = draws.withColumn("_place", F.when(F.col("_n") >= half, F.col("draw").cast("long")).otherwise(again)).drop("_n")
    return ranked.join(draws, [label, "_place"]).drop("_place")


def compose_by_share(sources: DataFrame, shares: dict[str, float], total: int, source_col: str = "source", id_col: str = "clip_id", seed: int = 0) -> DataFrame:
    """int(total * share) rows of each source, the rest for the last; a short source gives all it has."""
    quota, left, chain = {}, total, F.lit(0)
    names = list(shares)
    for name in names[:-1]:
        quota[name] = int(total * shares[name])
        left -= quota[name]
    quota[names[-1]] = left
    for name, k in quota.items():
        chain = F.when(F.col(source_col) == name, k).otherwise(chain)
    return _placed(sources, [source_col], id_col, seed).filter(F.col("_place") <= chain).drop("_place", "_size")


def split_summary(df: DataFrame, split: str = "split", label: str = "ground_truth", conditions: list[str] | None = None) -> DataFrame:
    """Counts by split, split x label and split x conditions x label in one pass; level tells them apart."""
    conditions = conditions or ["duration_ms", "snr_db"]
    columns = [split, label, *conditions]
    sets = [[split], [split, label], [split, label, *conditions]]
    out = df.groupingSets(sets, *columns).agg(F.grouping_id(*columns).cast("long").alias("level"), F.count(F.lit(1)).alias("n"))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy("level")), 6)
    return out.withColumn("share", share)
