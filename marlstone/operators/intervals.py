"""Intervals per recording: merging, cropping, gaps and slices. Times are float seconds, intervals half open."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def _parts(rows: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Adds _part, rising with start_s: ranges of about equally many rows of a key, so a key may hold most rows."""
    if parts < 2:
        return rows.withColumn("_part", F.lit(0))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("start_s", [i / parts for i in range(1, parts)], 1000).alias("_cuts"))
    return rows.join(cuts, keys).withColumn("_part", F.size(F.filter("_cuts", lambda c: c <= F.col("start_s")))).drop("_cuts")


def _island_starts(df: DataFrame, keys: list[str], parts: int) -> tuple[DataFrame, DataFrame]:
    """(keys, _part, start_s, _before) of intervals that begin after all before them have ended, at _before; and keys, _part, _last, the end of all.

    The running end is taken inside ranges of time, from the largest end of the ranges before.
    """
    rows = _parts(df.filter("end_s > start_s").select(*keys, "start_s", "end_s"), keys, parts)
    ends = rows.groupBy(*keys, "_part").agg(F.max("end_s").alias("_top"))
    whole = Window.partitionBy(*keys)  # a row a range
    carry = F.max("_top").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*keys, "_part", carry.alias("_carry"), F.max("_top").over(whole).alias("_last"))
    within = Window.partitionBy(*keys, "_part").orderBy("start_s", "end_s").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_end", F.max("end_s").over(within)).join(ends, [*keys, "_part"]).withColumn("_before", F.greatest("_end", "_carry"))
    starts = rows.filter("_before is null or start_s > _before").select(*keys, "_part", "start_s", "_before")
    return starts, ends.select(*keys, "_part", "_last")


def merge_intervals(df: DataFrame, keys: list[str], parts: int = 64) -> DataFrame:
    """keys, start_s, end_s: unions of overlapping or touching intervals; empty intervals are dropped. A union ends where the next one's start found the running end."""
    starts, ends = _island_starts(df, keys, parts)
    heads = starts.groupBy(*keys, "_part").agg(F.min_by(F.struct("_before"), "start_s").alias("_head"))
    later = Window.partitionBy(*keys).orderBy("_part").rowsBetween(1, Window.unboundedFollowing)  # a row a range
    ahead = ends.join(heads, [*keys, "_part"], "left").withColumn("_next", F.first("_head", ignorenulls=True).over(later))
    following = F.lead("_before").over(Window.partitionBy(*keys, "_part").orderBy("start_s"))
    rows = starts.withColumn("_then", following).join(ahead.select(*keys, "_part", "_next", "_last"), [*keys, "_part"])
    return rows.select(*keys, "start_s", F.coalesce("_then", "_next._before", "_last").alias("end_s"))


def crop_intervals(segments: DataFrame, regions: DataFrame, key: str = "uri") -> DataFrame:
    """Segments cut to the valid regions of their recording; recordings without regions are kept as they are.

    Both sides lie in cells of time, as wide as an interval is on average, and meet by recording and cell: a pair counts in the first cell
    that both lie in, so pairs looked at grow with the segments, not with their product.
    """
    span = lambda a, b: F.sum(F.abs(F.col(b) - F.col(a)))
    sizes = segments.agg(span("start_s", "end_s").alias("s"), F.count(F.lit(1)).alias("n")).unionByName(regions.agg(span("start_s", "end_s").alias("s"), F.count(F.lit(1)).alias("n")))
    width = sizes.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).select(F.when(F.col("s") > 0, F.col("s") / F.col("n")).otherwise(1.0).alias("_width"))  # one row
    r = regions.select(F.col(key).alias("_key"), F.col("start_s").alias("_from"), F.col("end_s").alias("_to"))

    def celled(df, a, b):
        cell = lambda t: F.floor(t / F.col("_width")).cast("long")
        low = cell(F.least(a, b))
        return df.join(F.broadcast(width)).withColumn("_low", low).withColumn("_cell", F.explode(F.sequence(low, cell(F.greatest(a, b)))))

    left, right = celled(segments, "start_s", "end_s").drop("_width"), celled(r, "_from", "_to").drop("_width").withColumnsRenamed({"_low": "_low_r", "_cell": "_cell_r"})
    meets = (F.col(key) == F.col("_key")) & (F.col("_cell") == F.col("_cell_r")) & (F.col("_cell") == F.greatest("_low", "_low_r"))
    joined = left.join(right, meets & (F.col("start_s") < F.col("_to")) & (F.col("end_s") > F.col("_from")))
    cut = joined.withColumn("start_s", F.greatest("start_s", "_from")).withColumn("end_s", F.least("end_s", "_to"))
    free = segments.join(regions.select(key).distinct(), key, "left_anti")
    return cut.select(*segments.columns).unionByName(free.select(*segments.columns))


def interval_gaps(speech: DataFrame, extents: DataFrame | None = None, key: str = "uri", parts: int = 64) -> DataFrame:
    """key, start_s, end_s: what lies between merged intervals, inside the extent of the recording.

    ``extents`` holds key, start_s, end_s; where it has no row the intervals' own extent counts.
    """
    starts, _ = _island_starts(speech, [key], parts)
    between = starts.filter("_before is not null").select(key, F.col("_before").alias("start_s"), F.col("start_s").alias("end_s"))
    if extents is None:
        return between
    own = speech.filter("end_s > start_s").groupBy(key).agg(F.min("start_s").alias("own_from"), F.max("end_s").alias("own_to"))
    given = extents.groupBy(key).agg(F.min("start_s").alias("given_from"), F.max("end_s").alias("given_to"))
    own = own.join(given, key, "full_outer").withColumn("low", F.coalesce("given_from", "own_from")).withColumn("high", F.coalesce("given_to", "own_to"))
    pair = lambda a, b: F.struct(F.col(a).alias("start_s"), F.coalesce(b, "high").alias("end_s"))
    sides = own.select(key, "low", "high", F.inline(F.array_compact(F.array(pair("low", "own_from"), F.when(F.col("own_to").isNotNull(), pair("own_to", "high"))))))
    gaps = between.join(own.select(key, "low", "high"), key).unionByName(sides)
    out = gaps.select(key, F.greatest("start_s", "low").alias("start_s"), F.least("end_s", "high").alias("end_s"))
    return out.filter("end_s > start_s")


def slice_intervals(df: DataFrame, durations_ms: list[int], buffer_s: float = 1.0, max_per_interval: int | None = None) -> DataFrame:
    """Input columns (start_s, end_s as slice bounds) plus duration_ms and slice_no: slices inside the interval less a buffer at both ends."""
    rows = df.withColumn("safe_start", F.col("start_s") + F.lit(buffer_s)).withColumn("safe_end", F.col("end_s") - F.lit(buffer_s))
    rows = rows.withColumn("duration_ms", F.explode(F.array(*[F.lit(d) for d in durations_ms])))
    length = F.col("duration_ms") / F.lit(1000.0)
    rows = rows.withColumn("n", F.floor((F.col("safe_end") - F.col("safe_start")) / length).cast("int"))
    if max_per_interval is not None:
        rows = rows.withColumn("n", F.least("n", F.lit(max_per_interval)))
    rows = rows.filter("n > 0").withColumn("slice_no", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.withColumn("start_s", F.col("safe_start") + F.col("slice_no") * length)
    rows = rows.withColumn("end_s", F.col("start_s") + length).filter("end_s <= safe_end")
    return rows.drop("safe_start", "safe_end", "n")


def _near_start(df: DataFrame, keys: list[str], n: int, order: list[str]) -> DataFrame:
    """Rows of which some are the first ``n`` of their key (null is one), mostly few more: what surely lies beyond goes, without a sort.

    The rows of a key are dealt to 4 * n parts by hash. Of the least first order value of each part, the n-th least has n rows up to it. A
    key with rows in fewer parts keeps all.
    """
    lead, key = F.col(order[0]), F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("all"))
    least = df.groupBy(key.alias("_key"), F.pmod(F.xxhash64(*order), F.lit(4 * n)).alias("_part")).agg(F.min(lead).alias("_least"))
    ends = least.groupBy("_key").agg(F.get(F.array_sort(F.collect_list("_least")), F.lit(n - 1)).alias("_end"))
    rows = df.withColumn("_key", key).join(written(ends, "cap-ends"), "_key")
    return rows.filter(F.col("_end").isNull() | lead.isNull() | (lead <= F.col("_end"))).drop("_key", "_end")


def cap_per_config(df: DataFrame, keys: list[str], n: int, order: list[str], salts: int = 64) -> DataFrame:
    """The first ``n`` rows of every key: of each salted part first, so that few large keys do not fill a task. Only rows near the start of their key are ranked."""
    if n <= 0:
        return df.limit(0)
    part = F.pmod(F.xxhash64(*order), F.lit(salts))
    first = Window.partitionBy(*keys, "_part").orderBy(*order)
    then = Window.partitionBy(*keys).orderBy(*order)
    rows = _near_start(df, keys, n, order).withColumn("_part", part).withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= n)
    return rows.withColumn("_place", F.row_number().over(then)).filter(F.col("_place") <= n).drop("_part", "_place")


def segment_clips(waveforms: DataFrame, segments: DataFrame, key: str = "uri") -> tuple[DataFrame, DataFrame]:
    """Segments with their samples, and the segments whose recording is missing. waveforms: key, samples, sr. For long recordings sources.audio.read_segments reads ranges of their files."""
    cut = segments.join(waveforms.select(key, "samples", "sr"), key)
    first, end = F.floor(F.col("start_s") * F.col("sr")).cast("int"), F.floor(F.col("end_s") * F.col("sr")).cast("int")
    clips = cut.withColumn("samples", F.slice("samples", first + 1, F.greatest(end - first, F.lit(0))))
    return clips, segments.join(waveforms.select(key), key, "left_anti")


def speech_ratio(segments: DataFrame, clips: DataFrame, min_ratio: float = 0.8, key: str = "clip_id") -> DataFrame:
    """key, ratio of segment length to clip length (duration_s) and whether it reaches ``min_ratio``."""
    sums = segments.groupBy(key).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("speech_s"))
    rows = clips.join(sums, key, "left").withColumn("ratio", F.coalesce("speech_s", F.lit(0.0)) / F.col("duration_s"))
    return rows.select(key, "ratio", (F.col("ratio") >= min_ratio).alias("passed"))
