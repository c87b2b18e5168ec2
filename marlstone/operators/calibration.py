"""Calibration of probabilities: reliability bins, expected error, Brier score and temperature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import sigmoid
from .common import written
from .metrics import POSITIVE


def bin_of(p: Column, bins: int) -> Column:
    """Half-open bins by their edges i / bins; 1.0 lies in none."""
    out = F.lit(None).cast("int")
    for i in reversed(range(bins)):
        out = F.when((p >= F.lit(i / bins)) & (p < F.lit((i + 1) / bins)), i).otherwise(out)
    return out


def reliability_bins(df: DataFrame, bins: int = 10, prob: str = "prob", by: list[str] | None = None) -> DataFrame:
    """by, bin, n, mean_prob, share_correct: of rows in a bin."""
    by = by or []
    rows = df.withColumn("bin", bin_of(F.col(prob), bins)).filter("bin is not null")
    return rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_prob"), F.avg(F.col("correct").cast("int")).alias("share_correct"))


def ece(df: DataFrame, bins: int = 10, prob: str = "prob", by: list[str] | None = None) -> DataFrame:
    """by, ece: |mean probability - share correct| weighted by n over all rows, those in no bin included."""
    by = by or []
    cells = df.withColumn("bin", bin_of(F.col(prob), bins)).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("m"), F.avg(F.col("correct").cast("int")).alias("c"))
    weighted = F.sum(F.when(F.col("bin").isNotNull(), F.abs(F.col("m") - F.col("c")) * F.col("n")).otherwise(0.0))
    return cells.groupBy(*by).agg((weighted / F.sum("n")).alias("ece"))


def brier(df: DataFrame, prob: str = "prob", by: list[str] | None = None) -> DataFrame:
    truth = (F.col("ground_truth") == POSITIVE).cast("double")
    return df.groupBy(*(by or [])).agg(F.avg((F.col(prob) - truth) * (F.col(prob) - truth)).alias("brier"))


def at_temperatures(df: DataFrame, temperatures: list[float], logit: str = "logit_diff") -> DataFrame:
    """A row of ``df`` for each temperature: temperature_no, temperature, prob, correct."""
    grid = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(float(t)).alias("t")) for i, t in enumerate(temperatures)])
    rows = df.select("ground_truth", F.col(logit).cast("double").alias("_logit"), F.explode(grid).alias("_g"))
    rows = rows.select("ground_truth", F.col("_g.no").alias("temperature_no"), F.col("_g.t").alias("temperature"), sigmoid(F.col("_logit") / F.col("_g.t")).alias("prob"))
    return rows.withColumn("correct", (F.col("prob") >= 0.5) == (F.col("ground_truth") == POSITIVE))


def _errors_at(cells: DataFrame, brackets: DataFrame, by: list[str], steps: int, bins: int) -> DataFrame:
    """by, _from, _to, _i, t, ece, brier at ``steps`` + 1 temperatures of every bracket (by, _from, _to); p = 0.5 is predicted positive."""
    points = brackets.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    points = points.withColumn("t", F.col("_from") + F.col("_i") * (F.col("_to") - F.col("_from")) / F.lit(float(max(steps, 1))))
    rows = cells.join(points, by) if by else cells.join(F.broadcast(points))  # some hundred temperatures
    keys, p, truth = [*by, "_from", "_to", "_i", "t"], F.col("p"), F.col("_truth")
    rows = rows.withColumn("p", sigmoid(F.col("_logit") / F.col("t"))).withColumn("bin", bin_of(p, bins))
    correct = ((p >= 0.5) == (truth == 1)).cast("int")
    sums = rows.groupBy(*keys, "bin").agg(F.sum("w").alias("n"), F.sum(p * F.col("w")).alias("sp"), F.sum(correct * F.col("w")).alias("sc"), F.sum((p - truth) * (p - truth) * F.col("w")).alias("sb"))
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("sp") - F.col("sc"))).otherwise(0.0)
    return sums.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("ece"), (F.sum("sb") / F.sum("n")).alias("brier"))


def find_temperature(df: DataFrame, temperatures: list[float] | None = None, by: list[str] | None = None, low: float = 0.1, high: float = 10.0, points: int = 100, rounds: int = 3, minima: int = 3, bins: int = 10, logit: str = "logit_diff") -> DataFrame:
    """by, temperature of the least expected error in [low, high] (the first of equals), and error and Brier score before (at 1) and after.

    The error jumps where a logit changes its bin, so it has many minima: a grid of ``points`` first, then, ``rounds`` times, ten
    steps around each of the ``minima`` best local minima so far found, for all groups at once. The best of all points counts, so
    the error is never above the grid's. Logits are grouped first: a point costs a row per distinct logit. Where
    ``temperatures`` are given, one of these is taken.
    """
    by = by or []
    cells = df.groupBy(*by, (F.col("ground_truth") == POSITIVE).cast("int").alias("_truth"), F.col(logit).cast("double").alias("_logit")).agg(F.count(F.lit(1)).alias("w"))
    cells = written(cells.filter("_logit is not null"), "logits")
    groups = cells.select(*by).distinct() if by else cells.sparkSession.range(1).select()
    at = lambda a, b: groups.select("*", F.lit(float(a)).alias("_from"), F.lit(float(b)).alias("_to"))
    error = F.round("ece", 9)
    if temperatures:
        given = groups.withColumn("_from", F.explode(F.array(*[F.lit(float(t)) for t in temperatures]))).withColumn("_to", F.col("_from"))
        found, steps, rounds = [_errors_at(cells, given, by, 0, bins)], 0, 0
    else:
        found, steps = [written(_errors_at(cells, at(low, high), by, points - 1, bins), "errors")], points - 1
    for _ in range(rounds):
        near = Window.partitionBy(*by, "_from", "_to").orderBy("_i")
        rows = found[-1].withColumn("_e", error).withColumn("_b", F.lag(error).over(near)).withColumn("_a", F.lead(error).over(near))
        rows = rows.filter("(_b is null or _e <= _b) and (_a is null or _e <= _a)")
        rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by, F.lit(0)).orderBy("_e", "t", "_i"))).filter(F.col("_place") <= minima)
        width = (F.col("_to") - F.col("_from")) / F.lit(float(steps))
        next_ = rows.select(*by, F.greatest(F.lit(low), F.col("t") - width).alias("_from"), F.least(F.lit(high), F.col("t") + width).alias("_to")).distinct()
        found, steps = [*found, written(_errors_at(cells, next_, by, 10, bins), "errors")], 10
    all_points = found[0]
    for more in found[1:]:
        all_points = all_points.unionByName(more)
    best = all_points.groupBy(*by).agg(F.min_by(F.struct("t", "ece", "brier"), F.struct(error.alias("e"), "t")).alias("b"))
    before = _errors_at(cells, at(1.0, 1.0), by, 0, bins).select(*by, F.col("ece").alias("ece_before"), F.col("brier").alias("brier_before"))
    out = best.join(before, by) if by else best.join(F.broadcast(before))  # one row
    return out.select(*by, F.col("b.t").alias("temperature"), "ece_before", F.col("b.ece").alias("ece_after"), "brier_before", F.col("b.brier").alias("brier_after"))
