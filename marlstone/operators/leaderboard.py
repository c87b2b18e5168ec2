"""Tables over runs, seeds, prompts and search histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import accuracy_table, class_accuracies, wilson
from .ranking import roc_auc


def seed_summary(df: DataFrame, seed: str = "run") -> DataFrame:
    """metric, mean, std (sample; 0 for one seed), n_seeds over per-seed metrics."""
    per = accuracy_table(df, [seed])
    metrics = ("accuracy", "acc_pos", "acc_neg")
    long = per.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("r")).select("r.*")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("n_seeds"))


def seed_disagreements(df: DataFrame, order: list[str], seed: str = "run", clip: str = "clip_id") -> DataFrame:
    """clip, ground_truth, predictions and correct_flags (maps by seed), n_seeds, agreement_rate (share of right ones) of clips with more than one prediction.

    Clips are those of the smallest seed, whose ground truth counts; of several rows of a seed and clip the first by ``order``.
    """
    rows = df.select(seed, clip, F.struct("prediction", "correct", "ground_truth").alias("_v"), F.struct(*order).alias("_o"))
    rows = rows.groupBy(seed, clip).agg(F.min_by("_v", "_o").alias("_v"))
    least = df.agg(F.min(seed).alias("_least"))
    entry = lambda field: F.map_from_entries(F.array_sort(F.collect_list(F.struct(seed, f"_v.{field}"))))
    out = rows.groupBy(clip).agg(F.min(seed).alias("_first"), F.min_by("_v.ground_truth", seed).alias("ground_truth"), entry("prediction").alias("predictions"), entry("correct").alias("correct_flags"), F.count(F.lit(1)).alias("n_seeds"), F.avg(F.col("_v.correct").cast("int")).alias("agreement_rate"), F.countDistinct("_v.prediction").alias("_different"))
    out = out.filter("_different > 1").join(F.broadcast(least), F.col("_first") == F.col("_least"))  # one row
    return out.drop("_first", "_least", "_different")


def ablation_summary(log: DataFrame, experiment: str, value: str) -> DataFrame:
    """experiment, mean, std, n, rounded to 2; runs without a result are left out."""
    rows = log.filter(F.col(value).isNotNull())
    return rows.groupBy(experiment).agg(F.round(F.avg(value), 2).alias("mean"), F.round(F.stddev_samp(value), 2).alias("std"), F.count(F.lit(1)).alias("n"))


def comparison_table(df: DataFrame, run: str = "run", z: float = 1.959964) -> DataFrame:
    """A row per run: accuracy with Wilson bounds overall and by class, mean confidence, AUC; best first."""
    pos, neg = F.col("ground_truth") == "SPEECH", F.col("ground_truth") == "NONSPEECH"
    count = lambda c: F.sum(c.cast("long"))
    t = df.groupBy(run).agg(F.count(F.lit(1)).alias("n"), count(F.col("correct")).alias("k"), count(pos).alias("n_pos"), count(pos & F.col("correct")).alias("k_pos"), count(neg).alias("n_neg"), count(neg & F.col("correct")).alias("k_neg"), F.avg("confidence").alias("mean_confidence"))
    for n, k, name in (("n", "k", "acc"), ("n_pos", "k_pos", "acc_pos"), ("n_neg", "k_neg", "acc_neg")):
        size = F.nullif(F.col(n), F.lit(0)).cast("double")
        low, high = wilson(F.col(k).cast("double"), size, z)
        t = t.withColumn(name, F.coalesce(F.col(k) / size, F.lit(0.0))).withColumn(f"{name}_low", F.coalesce(low, F.lit(0.0))).withColumn(f"{name}_high", F.coalesce(high, F.lit(0.0)))
    return t.drop("k", "k_pos", "k_neg").join(roc_auc(df, [run]), run).orderBy(F.desc("acc"), run)


def config_table(df: DataFrame, values: list[str], run: str = "run") -> DataFrame:
    """A row per run: balanced accuracy overall and a column for each variant type, in %, rounded to 2."""
    ba = class_accuracies()["ba"]
    overall = df.groupBy(run).agg(F.round(100 * ba, 2).alias("global_ba"))
    return overall.join(df.groupBy(run).pivot("variant_type", values).agg(F.round(100 * ba, 2)), run)


def prompt_accuracy(log: DataFrame, by: list[str]) -> DataFrame:
    """by, n, n_correct, accuracy."""
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_correct").cast("long")).alias("n_correct"), F.avg(F.col("is_correct").cast("int")).alias("accuracy"))


def best_prompts(log: DataFrame, k: int = 1, iteration: str = "iteration", prompt: str = "prompt_id") -> DataFrame:
    """The ``k`` best prompts of every iteration, the first by id of equals, with their place."""
    rows = prompt_accuracy(log, [iteration, prompt])
    place = F.row_number().over(Window.partitionBy(iteration).orderBy(F.desc("accuracy"), prompt))
    return rows.withColumn("place", place).filter(F.col("place") <= k)


def iteration_summary(log: DataFrame, fmt: str = "decoding_mode", iteration: str = "iteration") -> DataFrame:
    """fmt, iterations, rows, overall, best (with its first iteration) and final accuracy."""
    per = prompt_accuracy(log, [fmt, iteration])
    best = F.max_by(F.struct(iteration, "accuracy"), F.struct("accuracy", (-F.col(iteration)).alias("i")))
    return per.groupBy(fmt).agg(F.count(F.lit(1)).alias("iterations"), F.sum("n").alias("rows"), (F.sum("n_correct") / F.sum("n")).alias("overall"), best.alias("b"), F.max_by("accuracy", iteration).alias("final")).select(
        fmt, "iterations", "rows", "overall", F.col("b.accuracy").alias("best"), F.col(f"b.{iteration}").alias("best_iteration"), "final"
    )


def iteration_matrix(log: DataFrame, values: list, fmt: str = "decoding_mode", iteration: str = "iteration") -> DataFrame:
    return log.groupBy(iteration).pivot(fmt, values).agg(F.avg(F.col("is_correct").cast("int")))


def reward(ba_clip: Column, ba_cond: Column, length: Column) -> Column:
    return F.lit(1.0) * ba_clip + F.lit(0.25) * ba_cond - F.lit(0.05) * length / 100.0


def prompt_memory(history: DataFrame, k: int, order: list[str]) -> DataFrame:
    """The ``k`` candidates of the highest reward, earlier ones first among equals."""
    return history.orderBy(F.desc("reward"), *order).limit(k)


def best_so_far(history: DataFrame, patience: int = 5, iteration: str = "iteration") -> DataFrame:
    """iteration, reward (best of the iteration), best, improved, since (iterations without improvement), stop. Iterations are few: the candidates of each are reduced first."""
    per = history.groupBy(iteration).agg(F.max("reward").alias("reward"))
    order = Window.partitionBy(F.lit(0)).orderBy(iteration)
    before = F.max("reward").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = per.withColumn("improved", before.isNull() | (F.col("reward") > before)).withColumn("best", F.max("reward").over(order))
    rows = rows.withColumn("_run", F.sum(F.col("improved").cast("int")).over(order))
    rows = rows.withColumn("since", F.row_number().over(Window.partitionBy("_run").orderBy(iteration)) - 1).drop("_run")
    return rows.withColumn("stop", F.col("since") >= patience)
