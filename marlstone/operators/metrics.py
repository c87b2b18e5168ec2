"""Accuracies, conditions and scores of predictions.

Predictions have ground_truth, prediction or correct, and condition columns; ``positive`` names the label that
counts as such. Class accuracies are taken over the rows of the class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quantiles

POSITIVE, NEGATIVE = "SPEECH", "NONSPEECH"


def _share(condition: Column, correct: Column) -> Column:
    """Share of correct rows among those of the condition; null without any."""
    return F.avg(F.when(condition, correct.cast("int")))


def class_accuracies(truth: str = "ground_truth", correct: str = "correct", absent: str = "zero") -> dict[str, Column]:
    pos, neg = (_share(F.col(truth) == v, F.col(correct)) for v in (POSITIVE, NEGATIVE))
    if absent == "zero":
        pos0, neg0 = F.coalesce(pos, F.lit(0.0)), F.coalesce(neg, F.lit(0.0))
        return {"ba": (pos0 + neg0) / 2, "acc_pos": pos0, "acc_neg": neg0}
    return {"ba": F.coalesce((pos + neg) / 2, pos, neg), "acc_pos": pos, "acc_neg": neg}


def counts(truth: str = "ground_truth", correct: str = "correct") -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(correct).cast("long")).alias("n_correct"),
        F.sum((F.col(truth) == POSITIVE).cast("long")).alias("n_pos"),
        F.sum((F.col(truth) == NEGATIVE).cast("long")).alias("n_neg"),
    ]


def accuracy_table(df: DataFrame, by: list[str]) -> DataFrame:
    """by, n, n_correct, accuracy, acc_pos, acc_neg; an empty class counts 0."""
    c = class_accuracies()
    return df.groupBy(*by).agg(*counts()[:2], F.coalesce(F.avg(F.col("correct").cast("int")), F.lit(0.0)).alias("accuracy"), c["acc_pos"].alias("acc_pos"), c["acc_neg"].alias("acc_neg"))


def balanced_accuracy(df: DataFrame, by: list[str], absent: str = "zero") -> DataFrame:
    """by, ba, acc_pos, acc_neg, n, n_pos, n_neg. absent: an absent class counts "zero" or is left out ("skip")."""
    c = class_accuracies(absent=absent)
    n, _, n_pos, n_neg = counts()
    return df.groupBy(*by).agg(*[v.alias(k) for k, v in c.items()], n, n_pos, n_neg)


DIMENSIONS = {"duration": "duration_ms", "snr": "snr_db", "filter": "band_filter", "reverb": "t60_bin"}


def unpivot_conditions(df: DataFrame, dimensions: dict[str, str] | None = None) -> DataFrame:
    """A row for each dimension with a value: dimension, value (as text)."""
    dims = dimensions or DIMENSIONS
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(c).cast("string").alias("value")) for k, c in dims.items()])
    rows = df.withColumn("_pair", F.explode(pairs)).filter("_pair.value is not null")
    return rows.withColumn("dimension", F.col("_pair.dimension")).withColumn("value", F.col("_pair.value")).drop("_pair")


def macro_over_conditions(df: DataFrame, dimensions: dict[str, str] | None = None) -> DataFrame:
    """dimension, n_values, macro_ba: unweighted mean of balanced accuracies by value, all dimensions in one pass."""
    cells = balanced_accuracy(unpivot_conditions(df, dimensions), ["dimension", "value"])
    return cells.groupBy("dimension").agg(F.count(F.lit(1)).alias("n_values"), F.avg("ba").alias("macro_ba"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, within [0, 1]; (0, 0) for n = 0."""
    p = k / n
    denominator = 1 + F.lit(z * z) / n
    centre = (p + F.lit(z * z) / (2 * n)) / denominator
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / denominator
    low, high = F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def wilson_interval(df: DataFrame, k: str = "n_correct", n: str = "n", z: float = 1.96) -> DataFrame:
    """Adds ci_low and ci_high."""
    size = F.nullif(F.col(n), F.lit(0)).cast("double")
    low, high = wilson(F.col(k).cast("double"), size, z)
    return df.withColumn("ci_low", low).withColumn("ci_high", high)


def metrics_by_condition(df: DataFrame, dims: tuple[str, str, str] = ("duration_ms", "snr_db", "ground_truth")) -> DataFrame:
    """n, n_correct, accuracy in % with Wilson bounds at seven levels of grouping, in one pass; level: bits of the columns left out."""
    d, s, c = dims
    sets = [[d], [s], [c], [d, c], [s, c], [d, s], []]
    out = df.groupingSets(sets, d, s, c).agg(F.grouping_id(d, s, c).cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("long")).alias("n_correct"))
    return wilson_interval(out.withColumn("accuracy_pct", 100.0 * F.col("n_correct") / F.col("n")))


def condition_metrics(df: DataFrame) -> DataFrame:
    """Balanced accuracy by variant type and condition, by type, and overall; level 0, 1 and 3."""
    c = class_accuracies()
    n, _, n_pos, n_neg = counts()
    return df.rollup("variant_type", "condition").agg(F.grouping_id().cast("long").alias("level"), *[v.alias(k) for k, v in c.items()], n, n_pos, n_neg)


def confusion(by_pred: str = "prediction", truth: str = "ground_truth") -> dict[str, Column]:
    pos, hit = F.col(truth) == POSITIVE, F.col(by_pred) == POSITIVE
    count = lambda c: F.sum(c.cast("long"))
    return {"tp": count(pos & hit), "fn": count(pos & ~hit), "fp": count(~pos & hit), "tn": count(~pos & ~hit)}


def macro_f1(df: DataFrame, by: list[str]) -> DataFrame:
    """by, f1_pos, f1_neg, macro_f1; 0 where a class is neither there nor predicted."""
    cells = df.groupBy(*by).agg(*[v.alias(k) for k, v in confusion().items()])
    f1 = lambda hit: F.coalesce(F.try_divide(2.0 * F.col(hit), 2 * F.col(hit) + F.col("fp") + F.col("fn")), F.lit(0.0))
    return cells.select(*by, f1("tp").alias("f1_pos"), f1("tn").alias("f1_neg"), ((f1("tp") + f1("tn")) / 2).alias("macro_f1"))


def score_summary(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Mean, sample deviation, least and largest score, means of right and wrong rows and their gap."""
    right, wrong = F.avg(F.when(F.col("correct"), F.col(score))), F.avg(F.when(~F.col("correct"), F.col(score)))
    return df.groupBy(*by).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.min(score).alias("min"), F.max(score).alias("max"), right.alias("mean_correct"), wrong.alias("mean_wrong"), (right - wrong).alias("gap"))


def score_distribution(df: DataFrame, bins: int = 30, score: str = "score", truth: str = "ground_truth") -> DataFrame:
    """truth, bin, n, density over equal bins between the least and the largest score (the last bin is closed)."""
    ends = df.agg(F.min(score).alias("_low"), F.max(score).alias("_high"))  # one row
    rows = df.join(F.broadcast(ends)).withColumn("_width", (F.col("_high") - F.col("_low")) / bins)
    place = F.when(F.col("_width") > 0, F.floor((F.col(score) - F.col("_low")) / F.col("_width"))).otherwise(0)
    cells = rows.groupBy(truth, F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.max("_width").alias("_width"))
    total = F.sum("n").over(Window.partitionBy(truth))
    return cells.withColumn("density", F.try_divide(F.col("n") / total, F.col("_width"))).drop("_width")


def score_quartiles(df: DataFrame, score: str = "score", truth: str = "ground_truth", accuracy: int | None = None) -> DataFrame:
    """truth, q25, median, q75: exact, by narrowing ranges of scores, or by percentile_approx with ``accuracy``."""
    shares = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    if accuracy is None:
        return quantiles(df, [truth], score, shares)
    return df.groupBy(truth).agg(*[F.percentile_approx(score, q, accuracy).alias(name) for name, q in shares.items()])


def class_separation(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """by, mean_pos, mean_neg, separation; null where a class is missing."""
    pos, neg = (F.avg(F.when(F.col("ground_truth") == v, F.col(score))) for v in (POSITIVE, NEGATIVE))
    return df.groupBy(*by).agg(pos.alias("mean_pos"), neg.alias("mean_neg"), (pos - neg).alias("separation"))


def error_patterns(df: DataFrame, item: str, axis: str, score: str = "score") -> DataFrame:
    """item, always_wrong, flips, axis=correct pairs as text, and scores, a map of the axis to the mean score, for items that are ever wrong. Axis values are few."""
    point = F.struct(F.col(axis).alias("a"), F.col("correct").cast("int").alias("c"), F.round(score, 6).alias("s"))
    rows = df.groupBy(item).agg(F.bool_or("correct").alias("any"), F.bool_and("correct").alias("all"), F.array_sort(F.collect_set(point)).alias("points"))
    rows = rows.filter(~F.col("all"))
    text = F.array_join(F.transform("points", lambda p: F.concat_ws("", p["a"].cast("string"), F.lit("="), p["c"].cast("string"))), ",")
    scores = df.groupBy(item, axis).agg(F.avg(score).alias("s")).groupBy(item).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(axis, "s")))).alias("scores"))
    rows = rows.select(item, (~F.col("any")).alias("always_wrong"), F.col("any").alias("flips"), text.alias("pattern"))
    return rows.join(scores, item)


def low_high_contrast(df: DataFrame, axis: str = "snr_db", low: float = 0, high: float = 10, score: str = "score") -> DataFrame:
    """One row: class accuracies and mean scores at low and at high SNR, and whether positives score lower at low SNR."""
    at = {"low": F.col(axis) <= low, "high": F.col(axis) >= high}
    out = []
    for name, here in at.items():
        for side, label in (("pos", POSITIVE), ("neg", NEGATIVE)):
            out.append(_share(here & (F.col("ground_truth") == label), F.col("correct")).alias(f"acc_{side}_{name}"))
        out.append(F.avg(F.when(here & (F.col("ground_truth") == POSITIVE), F.col(score))).alias(f"score_{name}"))
    return df.agg(*out).withColumn("confirmed", F.col("score_low") < F.col("score_high"))


def condition_matrix(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Balanced accuracy of row x column cells, a column for each value; missing cells are null."""
    return df.groupBy(row).pivot(col, values).agg(class_accuracies()["ba"])


def errors(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("correct"))


def vad_decision(frames: DataFrame, rule: str, threshold: float = 0.5, key: str = "clip_id", prob: str = "prob") -> DataFrame:
    """Frames to clips. rule: "mean" above, "any" frame at or above (confidence: the largest, or 1 less it), "share" of speech frames above one half."""
    speech = F.sum((F.col(prob) >= threshold).cast("long"))
    out = frames.groupBy(key).agg(F.count(F.lit(1)).alias("n_frames"), speech.alias("n_speech"), F.avg(prob).alias("mean_prob"), F.min(prob).alias("min_prob"), F.max(prob).alias("max_prob"))
    decided = {"mean": F.col("mean_prob") > threshold, "any": F.col("n_speech") > 0, "share": F.col("n_speech") / F.col("n_frames") > 0.5}[rule]
    sure = {"mean": F.col("mean_prob"), "any": F.when(decided, F.col("max_prob")).otherwise(1 - F.col("max_prob")), "share": F.col("n_speech") / F.col("n_frames")}[rule]
    return out.withColumn("prediction", F.when(decided, POSITIVE).otherwise(NEGATIVE)).withColumn("confidence", sure)


def clip_vote(df: DataFrame, clip: str = "clip_id", by: list[str] | None = None) -> DataFrame:
    """by, clip, ground_truth, prediction by majority over its rows (ties: positive), correct, n_votes."""
    by = by or []
    votes = df.groupBy(*by, clip).agg(F.min("ground_truth").alias("ground_truth"), F.sum((F.col("prediction") == POSITIVE).cast("long")).alias("yes"), F.count(F.lit(1)).alias("n_votes"))
    votes = votes.withColumn("prediction", F.when(F.col("yes") * 2 >= F.col("n_votes"), POSITIVE).otherwise(NEGATIVE))
    return votes.select(*by, clip, "ground_truth", "prediction", (F.col("ground_truth") == F.col("prediction")).alias("correct"), "n_votes")


def clip_metrics(df: DataFrame, by: list[str] | None = None, clip: str = "clip_id") -> DataFrame:
    """by, n_clips, accuracy, ba, acc_pos, acc_neg, macro_f1 after the vote of each clip's rows: a clip counts once, however many variants it has."""
    by = by or []
    votes = clip_vote(df, clip, by)
    one = votes.withColumn("_all", F.lit(0))
    keys = [*by, "_all"]
    c = class_accuracies()
    out = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_clips"), F.avg(F.col("correct").cast("int")).alias("accuracy"), *[c[k].alias(k) for k in ("ba", "acc_pos", "acc_neg")], *[v.alias(k) for k, v in confusion().items()])
    f1 = lambda hit: F.coalesce(F.try_divide(2.0 * F.col(hit), 2 * F.col(hit) + F.col("fp") + F.col("fn")), F.lit(0.0))
    return out.withColumn("macro_f1", (f1("tp") + f1("tn")) / 2).drop("_all", "tp", "fn", "fp", "tn")


def gate_check(base: DataFrame, new: DataFrame, constrained_base: float, constrained_new: float) -> DataFrame:
    """One row with four criteria: balanced accuracy up 2 points, constrained not down 1, unknown below 5 %, 70 % of neighbouring durations not falling."""
    c = class_accuracies()
    b = base.agg(c["ba"].alias("ba_base"))
    n = new.agg(c["ba"].alias("ba_new"), F.avg((~F.col("prediction").isin(POSITIVE, NEGATIVE)).cast("int")).alias("unknown_rate"))
    by = new.groupBy("duration_ms").agg(c["ba"].alias("ba")).filter("duration_ms is not null")
    steps = by.withColumn("next", F.lead("ba").over(Window.partitionBy(F.lit(0)).orderBy("duration_ms"))).filter("next is not null")
    steps = steps.agg(F.coalesce(F.avg((F.col("next") >= F.col("ba")).cast("int")), F.lit(1.0)).alias("monotone_share"))
    row = b.join(n).join(steps)
    row = row.withColumn("gain_ok", F.col("ba_new") - F.col("ba_base") >= 0.02).withColumn("constrained_ok", F.lit(constrained_new - constrained_base >= -0.01))
    row = row.withColumn("unknown_ok", F.col("unknown_rate") < 0.05).withColumn("monotone_ok", F.col("monotone_share") >= 0.7)
    return row.withColumn("passed", F.col("gain_ok") & F.col("constrained_ok") & F.col("unknown_ok") & F.col("monotone_ok"))
