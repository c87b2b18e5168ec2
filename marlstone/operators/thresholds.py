"""Threshold sweeps: rows become counts by threshold index, and cumulative sums over indices give every cut at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import POSITIVE


def grid_value(index: Column, start: float, step: float) -> Column:
    return F.lit(start) + index * F.lit(step)


def _passed(score: Column, start: float, step: float, n: int, strict: bool) -> Column:
    """How many of the grid's thresholds the score passes (they are the first ones). The guess by division is set right by comparing."""
    guess = F.least(F.greatest(F.floor((score - F.lit(start)) / F.lit(step)).cast("int"), F.lit(-2)), F.lit(n + 1))

    def passes(i: Column) -> Column:
        t = grid_value(i, start, step)
        inside = (i >= 0) & (i < n)
        return inside & ((score > t) if strict else (score >= t))

    around = [guess + k for k in (2, 1, 0, -1)]
    out = F.least(F.greatest(guess - 1, F.lit(0)), F.lit(n))
    for i in reversed(around):
        out = F.when(passes(i), i + 1).otherwise(out)
    return out


def cumulative_confusion(df: DataFrame, start: float, step: float, n: int, by: list[str], strict: bool, score: str = "score", truth: str = "ground_truth") -> DataFrame:
    """by, index, threshold, tp, fp, fn, tn for each of the grid's n thresholds."""
    pos = (F.col(truth) == POSITIVE).cast("long")
    rows = df.select(*by, pos.alias("pos"), _passed(F.col(score).cast("double"), start, step, n, strict).alias("passed"))
    cells = rows.groupBy(*by, "passed").agg(F.sum("pos").alias("p"), F.sum(1 - F.col("pos")).alias("q"))
    groups = cells.groupBy(*by).agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"), F.collect_list(F.struct("passed", "p", "q")).alias("cells"))  # n + 1 cells at most
    out = groups.withColumn("index", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    above = lambda f: F.aggregate(F.filter("cells", lambda c: c["passed"] > F.col("index")), F.lit(0).cast("long"), lambda a, c: a + c[f])
    out = out.select(*by, "index", grid_value(F.col("index"), start, step).alias("threshold"), above("p").alias("tp"), above("q").alias("fp"), "_p", "_q")
    return out.select(*by, "index", "threshold", "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_q") - F.col("fp")).alias("tn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def confusion_at_thresholds(df: DataFrame, n: int = 101, step: float = 0.01, by: list[str] | None = None) -> DataFrame:
    """Counts, accuracy, precision, recall, f1 and specificity at every threshold (inclusive), and best: the first of the largest f1."""
    by = by or []
    out = cumulative_confusion(df, 0.0, step, n, by, strict=False)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = out.withColumn("accuracy", _ratio(tp + tn, tp + tn + fp + fn)).withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn))
    out = out.withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn)).withColumn("specificity", _ratio(tn, tn + fp))
    place = F.row_number().over(Window.partitionBy(*by, F.lit(0)).orderBy(F.desc("f1"), "index"))
    return out.withColumn("best", place == 1)


def sweep_threshold(df: DataFrame, start: float = 0.1, step: float = 0.01, n: int = 85, by: list[str] | None = None, strict: bool = True, absent: str = "skip", min_rows: int = 0, default: float = 0.5) -> DataFrame:
    """by, best_index, best_threshold, best_ba: the first threshold of the largest balanced accuracy; the default with 0 where none exceeds 0. Groups below ``min_rows`` are left out."""
    by = by or []
    curve = ba_curve(df, start, step, n, by, strict, absent)
    best = curve.groupBy(*by).agg(F.min_by(F.struct("index", "threshold", "ba"), F.struct((-F.col("ba")).alias("a"), F.col("index").alias("i"))).alias("b"), F.max("rows").alias("n"))
    best = best.filter(F.col("n") >= min_rows)
    some = F.col("b.ba") > 0
    return best.select(*by, "n", F.when(some, F.col("b.index")).alias("best_index"), F.when(some, F.col("b.threshold")).otherwise(default).alias("best_threshold"), F.when(some, F.col("b.ba")).otherwise(0.0).alias("best_ba"))


def ba_curve(df: DataFrame, start: float, step: float, n: int, by: list[str], strict: bool, absent: str = "zero") -> DataFrame:
    """by, index, threshold, ba, acc_pos, acc_neg, accuracy, rows."""
    cells = cumulative_confusion(df, start, step, n, by, strict)
    pos, neg = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.try_divide(F.col("tn").cast("double"), F.col("tn") + F.col("fp"))
    rows = F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ba = (zero(pos) + zero(neg)) / 2 if absent == "zero" else F.coalesce((pos + neg) / 2, pos, neg, F.lit(0.0))
    return cells.select(*by, "index", "threshold", ba.alias("ba"), zero(pos).alias("acc_pos"), zero(neg).alias("acc_neg"), _ratio(F.col("tp") + F.col("tn"), rows).alias("accuracy"), rows.alias("rows"))


OBJECTIVES = ("min_class", "positive", "negative", "overall")


def sweep_logit_threshold(df: DataFrame, start: float = -10.0, stop: float = 10.0, n: int = 200, score: str = "logit_diff") -> DataFrame:
    """objective, best_index, threshold, value, baseline (at 0) and delta for four objectives."""
    curve = ba_curve(df.withColumn("score", F.col(score)), start, (stop - start) / (n - 1), n, [], True)
    named = {"min_class": F.least("acc_pos", "acc_neg"), "positive": F.col("acc_pos"), "negative": F.col("acc_neg"), "overall": F.col("accuracy")}
    long = curve.select("index", "threshold", F.explode(F.array(*[F.struct(F.lit(k).alias("objective"), v.alias("value")) for k, v in named.items()])).alias("o")).select("index", "threshold", "o.*")
    best = long.groupBy("objective").agg(F.min_by(F.struct("index", "threshold", "value"), F.struct((-F.col("value")).alias("a"), F.col("index").alias("i"))).alias("b"))
    at_zero = ba_curve(df.withColumn("score", F.col(score)), 0.0, 1.0, 1, [], True)
    base = at_zero.select(F.explode(F.array(*[F.struct(F.lit(k).alias("objective"), v.alias("baseline")) for k, v in named.items()])).alias("o")).select("o.*")
    return best.join(base, "objective").select("objective", F.col("b.index").alias("best_index"), F.col("b.threshold").alias("threshold"), F.col("b.value").alias("value"), "baseline", (F.col("b.value") - F.col("baseline")).alias("delta"))
