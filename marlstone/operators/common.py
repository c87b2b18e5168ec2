"""Seeded hash order and column checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def hash_order(*ids: Column | str, seed: int = 0) -> Column:
    """Hex digest that orders rows at random, whatever their partitioning."""
    return F.md5(F.concat_ws("|", *[F.col(i).cast("string") if isinstance(i, str) else i.cast("string") for i in ids], F.lit(str(seed))))


def hash_unit(*ids: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) from the first 8 hex digits of the digest."""
    return F.conv(F.substring(hash_order(*ids, seed=seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required column: {', '.join(missing)}")
    return df


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; without that setting, below a temporary folder if the session runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: later steps read it instead of working it out anew."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "numbered") -> tuple[DataFrame, DataFrame]:
    """(``df`` with _place, from 0 in ``order`` within equal ``by``; table of by, _size).

    Rows are dealt by ranges of the sorted keys and counted there; the sizes of the ranges before are added. No task holds a key.
    """
    by = by or []
    keys = [F.col(c).asc_nulls_first() for c in [*by, *order]]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = written(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), name)
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)]) if by else F.lit(0)
    rows = rows.withColumn("_key", key)
    ranges = rows.groupBy("_key", "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("_key")  # a row a range
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("_key", "_range", (before - F.col("_first")).alias("_start"))
    placed = rows.join(starts, ["_key", "_range"]).withColumn("_place", F.col("_start") + F.col("_at"))
    sizes = ranges.groupBy("_key").agg(F.sum("_n").alias("_size"))
    sizes = sizes.select(*[F.col(f"_key.k{i}").alias(c) for i, c in enumerate(by)], "_size") if by else sizes.select("_size")
    return placed.select(*df.columns, "_place"), sizes


def quantiles(df: DataFrame, by: list[str], column: str, shares: dict[str, float], cells: int = 256, most: int = 50_000) -> DataFrame:
    """by and a column for each share: exact quantiles of ``column``, between two neighbours in proportion; nulls are left out.

    Rows become different values with their counts once, and later steps read those. Every wanted rank has a range of values. While one
    holds over ``most`` different values, it is cut into ``cells`` cells by a sketch, the rows of each are counted and the ones with
    wanted ranks are the next ranges, for all groups at once; ranges of a group do not overlap. Then the values in the ranges are
    sorted, at most ``most`` of each.
    """
    rows = df.filter(F.col(column).isNotNull()).select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], F.lit(0).alias("all")).alias("_key"), F.col(column).cast("double").alias("_v"))
    values = written(rows.groupBy("_key", "_v").agg(F.count(F.lit(1)).alias("_c")), "quantile-values")
    whole = values.groupBy("_key").agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_in"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    at = [(F.col("_n") - 1) * F.lit(float(q)) for q in shares.values()]
    ranks = F.array_distinct(F.array(*[f(a) for a in at for f in (F.floor, F.ceil)]))
    spans = written(whole.select("_key", "_low", "_high", "_in", F.lit(0).cast("long").alias("_below"), ranks.alias("_ranks")), "quantile-spans")
    inside = lambda spans: values.join(spans, "_key").filter(F.col("_v").between(F.col("_low"), F.col("_high")))
    large = (F.col("_in") > most) & (F.col("_low") < F.col("_high"))
    while spans.filter(large).limit(1).count():
        some = inside(spans.filter(large))
        cuts = some.groupBy("_key", "_low").agg(F.percentile_approx("_v", [i / cells for i in range(1, cells)], 10 * cells).alias("_cuts"))
        cuts = cuts.withColumn("_heads", F.array(*[F.get("_cuts", F.lit(i)) for i in range(15, cells - 1, 16)]).cast("array<double>"))
        upto = lambda cuts: F.size(F.filter(cuts, lambda c: c <= F.col("_v")))
        near = 16 * upto("_heads")  # a sixteenth of the cuts is looked through, then what lies between two of those
        cell = near + upto(F.slice("_cuts", near + 1, 16))
        found = some.join(cuts, ["_key", "_low"]).withColumn("_cell", cell).groupBy("_key", F.col("_low").alias("_from"), "_cell", (F.col("_v") == F.get("_cuts", F.col("_cell") - 1)).alias("_cut"))
        found = found.agg(F.count(F.lit(1)).alias("_in"), F.sum("_c").alias("_sum"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.first("_below").alias("_below"), F.first("_ranks").alias("_ranks"))
        before = F.coalesce(F.sum("_sum").over(Window.partitionBy("_key", "_from").orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = found.withColumn("_below", F.col("_below") + before)
        found = found.withColumn("_ranks", F.filter("_ranks", lambda r: (F.col("_below") <= r) & (r < F.col("_below") + F.col("_sum")))).filter(F.size("_ranks") > 0)
        spans = written(found.select(*spans.columns).unionByName(spans.filter(~large)), "quantile-spans")
    upto = F.col("_below") + F.sum("_c").over(Window.partitionBy("_key", "_low").orderBy("_v"))
    values = inside(spans).withColumn("_upto", upto).withColumn("_rank", F.explode(F.filter("_ranks", lambda r: (F.col("_upto") > r) & (F.col("_upto") - F.col("_c") <= r))))
    known = values.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_m"))  # two ranks a share
    out = known.join(whole, "_key")
    columns = []
    for name, q in shares.items():
        place = (F.col("_n") - 1) * F.lit(float(q))
        a, b = F.element_at("_m", F.floor(place)), F.element_at("_m", F.ceil(place))
        columns.append((a + (place - F.floor(place)) * (b - a)).alias(name))
    return out.select(*[F.col(f"_key.k{i}").alias(c) for i, c in enumerate(by)], *columns)


def first_by_hash(df: DataFrame, n: int, ids: list[str], seed: int = 0, most: int = 10_000) -> DataFrame:
    """The first ``n`` rows by (hash of ``ids``, ids). Where they end is found by counts of hash prefixes, made longer until few rows share one; the rest is a filter."""
    if n <= 0:
        return df.limit(0)
    rows = df.withColumn("_order", hash_order(*ids, seed=seed))
    prefix, need = "", n
    while True:
        here = rows.filter(F.col("_order").startswith(prefix)) if prefix else rows
        counts = {r[0]: r[1] for r in here.groupBy(F.substring("_order", 1, len(prefix) + 3)).count().collect()}  # 4,096 at most
        for p in sorted(counts):
            if need <= counts[p]:
                break
            need -= counts[p]
        else:
            return df  # no more than n rows
        prefix = p
        if counts[p] <= most or len(prefix) >= 30:
            break
    key = F.struct("_order", *ids)
    last = rows.filter(F.col("_order").startswith(prefix)).groupBy("_order", *ids).count().orderBy("_order", *ids).withColumn("_upto", F.sum("count").over(Window.orderBy("_order", *ids)))
    cut = last.filter(F.col("_upto") >= need).orderBy("_order", *ids).first()
    end = F.struct(F.lit(cut["_order"]).alias("_order"), *[F.lit(cut[c]).cast(df.schema[c].dataType).alias(c) for c in ids])
    if cut["_upto"] == need:
        return rows.filter(key <= end).drop("_order")
    # Of rows alike in hash and ids, as many as still fit.
    return rows.filter(key < end).unionByName(rows.filter(key == end).limit(need - (cut["_upto"] - cut["count"]))).drop("_order")
