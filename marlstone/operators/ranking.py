"""Ranking curves from class counts at distinct scores.

Cumulative counts over scores come in two passes - sums of ranges of scores first, then within each - so a
table of many distinct scores is not sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import POSITIVE


def score_counts(df: DataFrame, by: list[str], score: str = "score", truth: str = "ground_truth") -> DataFrame:
    """by, score, p, q: positives and negatives at each distinct score."""
    pos = (F.col(truth) == POSITIVE).cast("long")
    return df.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(F.sum(pos).alias("p"), F.sum(1 - pos).alias("q"))


def score_parts(cells: DataFrame, by: list[str], parts: int = 64) -> DataFrame:
    """Adds _part, rising with the score: ranges of about equally many distinct scores, by approximate quantiles."""
    if parts < 2:
        return cells.withColumn("_part", F.lit(0))
    cuts = cells.groupBy(*by).agg(F.percentile_approx("score", [i / parts for i in range(1, parts)], 1000).alias("_cuts"))
    rows = cells.join(cuts, by) if by else cells.join(F.broadcast(cuts))  # one row
    return rows.withColumn("_part", F.size(F.filter("_cuts", lambda c: c <= F.col("score")))).drop("_cuts")


def cumulative(cells: DataFrame, by: list[str], parts: int = 64) -> DataFrame:
    """Adds tp, fp (positives and negatives at or above the score) and the totals all_p, all_q."""
    ends = cells.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    rows = score_parts(cells, by, parts)
    rows = rows.join(ends, by) if by else rows.join(F.broadcast(ends))  # one row
    sums = rows.groupBy(*by, "_part").agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    higher = Window.partitionBy(*by, F.lit(0)).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "_part", *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"{c}0") for c in ("_p", "_q")])
    within = Window.partitionBy(*by, "_part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(starts, [*by, "_part"])
    rows = rows.withColumn("tp", F.col("_p0") + F.sum("p").over(within)).withColumn("fp", F.col("_q0") + F.sum("q").over(within))
    return rows.select(*by, "score", "p", "q", "tp", "fp", "all_p", "all_q")


def roc_auc(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """by, auc: chance that a positive scores above a negative, ties one half; null where a class is missing."""
    c = cumulative(score_counts(df, by, score), by)
    # Negatives strictly below a score's positives, and half of those level with them.
    below = F.col("all_q") - F.col("fp")
    wins = F.sum(F.col("p") * (below + F.col("q") / 2.0))
    return c.groupBy(*by).agg(F.try_divide(wins, F.max(F.col("all_p") * F.col("all_q")).cast("double")).alias("auc"))


def average_precision(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """by, ap: precision at each distinct score, weighted by the recall it adds; null without positives."""
    c = cumulative(score_counts(df, by, score), by)
    part = F.col("p") / F.col("all_p") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return c.groupBy(*by).agg(F.sum(F.when(F.col("all_p") > 0, part)).alias("ap"))


def roc_curve(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    c = cumulative(score_counts(df, by, score), by)
    return c.select(*by, F.col("score").alias("threshold"), F.try_divide(F.col("fp").cast("double"), "all_q").alias("fpr"), F.try_divide(F.col("tp").cast("double"), "all_p").alias("tpr"))


def pr_curve(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """by, threshold, precision, recall, prevalence."""
    c = cumulative(score_counts(df, by, score), by)
    total = F.col("all_p") + F.col("all_q")
    return c.select(*by, F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide(F.col("tp").cast("double"), "all_p").alias("recall"), (F.col("all_p") / total).alias("prevalence"))


def pr_auc(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """by, pr_auc by trapezoids over recall, from precision 1 at recall 0."""
    c = cumulative(score_counts(df, by, score), by)
    # The point before is the one without this score's own counts.
    tp, fp = F.col("tp") - F.col("p"), F.col("fp") - F.col("q")
    before = F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(1.0))
    area = F.try_divide(F.col("p").cast("double"), "all_p") * (F.col("tp") / (F.col("tp") + F.col("fp")) + before) / 2
    return c.groupBy(*by).agg(F.sum(area).alias("pr_auc"))
