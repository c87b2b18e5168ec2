"""Queries of leaderboards and experiment logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import leaderboard
from .base import query
from .metrics import _CUM, _FIRST, _NEG, _POS, _preds, _wilson_sql, rounded
from .roles import role

_ACC = "avg(CAST(correct AS INTEGER))"


@query(f"""WITH r AS (SELECT run, {_ACC} AS accuracy, {_POS} AS acc_pos, {_NEG} AS acc_neg FROM preds GROUP BY run), l AS (SELECT 'accuracy' AS metric, accuracy AS v FROM r UNION ALL SELECT 'acc_pos', acc_pos FROM r UNION ALL SELECT 'acc_neg', acc_neg FROM r)
SELECT metric, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std, count(*) AS n_seeds FROM l GROUP BY 1""", "preds")
def lb01_seed_summary(spark, d):
    return rounded(leaderboard.seed_summary(_preds(spark, d)))


@query("""WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, clip_id ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM preds) WHERE rn = 1),
g AS (SELECT clip_id, arg_min(ground_truth, run) AS ground_truth, min(run) AS first, string_agg(concat(run, '=', prediction), ',' ORDER BY run) AS predictions, string_agg(concat(run, '=', CAST(correct AS INTEGER)), ',' ORDER BY run) AS correct_flags, count(*) AS n_seeds, avg(CAST(correct AS INTEGER)) AS agreement_rate FROM f GROUP BY 1 HAVING count(DISTINCT prediction) > 1)
SELECT clip_id, ground_truth, predictions, correct_flags, n_seeds, round(agreement_rate, 6) AS agreement_rate FROM g WHERE first = (SELECT min(run) FROM preds)""", "preds")
def lb02_seed_disagreements(spark, d):
    rows = leaderboard.seed_disagreements(_preds(spark, d), _FIRST)
    text = lambda m, v: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"].cast("string"), v(e["value"]))), ",")
    rows = rows.withColumn("predictions", text("predictions", lambda v: v)).withColumn("correct_flags", text("correct_flags", lambda v: v.cast("int").cast("string")))
    return rounded(rows)


@query("SELECT prompt_id, round(avg(v), 2) AS mean, round(stddev_samp(v), 2) AS std, count(*) AS n FROM (SELECT prompt_id, iteration, 100.0::DOUBLE * avg(CAST(is_correct AS INTEGER)) AS v FROM log GROUP BY 1, 2) GROUP BY 1", "log")
def lb03_ablation_summary(spark, d):
    runs = role(spark, d, "log").groupBy("prompt_id", "iteration").agg((100.0 * F.avg(F.col("is_correct").cast("int"))).alias("v"))
    return leaderboard.ablation_summary(runs, "prompt_id", "v")


def _w(k, n, name):
    lo, hi = _wilson_sql(k, n, 1.959964)
    return f"round({k} / CAST({n} AS DOUBLE), 6) AS {name}, {lo} AS {name}_low, {hi} AS {name}_high"


@query(f"""WITH {_CUM}, u AS (SELECT run, round(sum(p * (aq - fp + q / 2)) / max(ap * aq), 6) AS auc FROM k GROUP BY run), t AS (SELECT run, count(*) AS n, count(*) FILTER (correct) AS kk, count(*) FILTER (ground_truth = 'SPEECH') AS n_pos, count(*) FILTER (ground_truth = 'SPEECH' AND correct) AS k_pos, count(*) FILTER (ground_truth = 'NONSPEECH') AS n_neg, count(*) FILTER (ground_truth = 'NONSPEECH' AND correct) AS k_neg, round(avg(confidence), 6) AS mean_confidence FROM preds GROUP BY run)
SELECT run, n, n_pos, n_neg, mean_confidence, {_w('kk', 'n', 'acc')}, {_w('k_pos', 'n_pos', 'acc_pos')}, {_w('k_neg', 'n_neg', 'acc_neg')}, auc FROM t JOIN u USING (run)""", "preds")
def lb04_comparison_table(spark, d):
    return rounded(leaderboard.comparison_table(_preds(spark, d)))


_BA100 = f"round(100 * (({_POS}) + ({_NEG})) / 2, 2)"


@query(f"""WITH g AS (SELECT run, {_BA100} AS global_ba FROM preds GROUP BY run), t AS (SELECT run, variant_type, {_BA100} AS ba FROM preds GROUP BY 1, 2)
SELECT g.run, global_ba""" + "".join(f", (SELECT ba FROM t WHERE t.run = g.run AND variant_type = '{v}') AS {v}" for v in ("duration", "snr", "band", "rir")) + " FROM g", "preds")
def lb05_config_table(spark, d):
    return leaderboard.config_table(_preds(spark, d), ["duration", "snr", "band", "rir"])


@query("SELECT prompt_id, count(*) AS n, sum(CAST(is_correct AS INTEGER))::BIGINT AS n_correct, round(avg(CAST(is_correct AS INTEGER)), 6) AS accuracy FROM log GROUP BY 1", "log")
def lb06_prompt_accuracy(spark, d):
    return rounded(leaderboard.prompt_accuracy(role(spark, d, "log"), ["prompt_id"]))


@query("""WITH a AS (SELECT iteration, prompt_id, count(*) AS n, sum(CAST(is_correct AS INTEGER))::BIGINT AS n_correct, avg(CAST(is_correct AS INTEGER)) AS accuracy FROM log GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY iteration ORDER BY accuracy DESC, prompt_id) AS p FROM a)
SELECT iteration, prompt_id, n, n_correct, round(accuracy, 6) AS accuracy, CAST(p AS INTEGER) AS place FROM r WHERE p <= 3""", "log")
def lb06_best_prompts(spark, d):
    return rounded(leaderboard.best_prompts(role(spark, d, "log"), 3))


@query("""WITH a AS (SELECT decoding_mode, iteration, count(*) AS n, sum(CAST(is_correct AS INTEGER)) AS k, avg(CAST(is_correct AS INTEGER)) AS accuracy FROM log GROUP BY 1, 2)
SELECT decoding_mode, count(*) AS iterations, sum(n)::BIGINT AS rows, round(sum(k) / CAST(sum(n) AS DOUBLE), 6) AS overall, round(max(accuracy), 6) AS best, arg_min(iteration, {'a': -accuracy, 'i': iteration}) AS best_iteration, round(arg_max(accuracy, iteration), 6) AS final FROM a GROUP BY 1""", "log")
def lb07_iteration_summary(spark, d):
    return rounded(leaderboard.iteration_summary(role(spark, d, "log")))


@query("SELECT iteration, round(avg(CAST(is_correct AS INTEGER)) FILTER (decoding_mode = 'free'), 6) AS free, round(avg(CAST(is_correct AS INTEGER)) FILTER (decoding_mode = 'constrained'), 6) AS constrained FROM log GROUP BY 1", "log")
def lb07_iteration_matrix(spark, d):
    return rounded(leaderboard.iteration_matrix(role(spark, d, "log"), ["free", "constrained"]))


_REWARD = "ba_clip + CAST(0.25 AS DOUBLE) * ba_cond - CAST(0.05 AS DOUBLE) * prompt_length / CAST(100 AS DOUBLE)"


def _history(spark, d):
    return role(spark, d, "history").withColumn("reward", leaderboard.reward(F.col("ba_clip"), F.col("ba_cond"), F.col("prompt_length")))


@query(f"SELECT candidate, round({_REWARD}, 9) AS reward FROM history", "history")
def lb08_reward(spark, d):
    return rounded(_history(spark, d).select("candidate", "reward"), 9)


@query(f"SELECT candidate, iteration, round({_REWARD}, 6) AS reward FROM history ORDER BY {_REWARD} DESC, iteration, candidate LIMIT 20", "history")
def lb09_prompt_memory(spark, d):
    return rounded(leaderboard.prompt_memory(_history(spark, d), 20, ["iteration", "candidate"]).select("candidate", "iteration", "reward"))


@query(f"""WITH p AS (SELECT iteration, max({_REWARD}) AS reward FROM history GROUP BY 1), b AS (SELECT *, max(reward) OVER (ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv, max(reward) OVER (ORDER BY iteration) AS best FROM p),
i AS (SELECT *, pv IS NULL OR reward > pv AS improved FROM b), r AS (SELECT *, sum(CAST(improved AS INTEGER)) OVER (ORDER BY iteration) AS k FROM i), s AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY iteration) - 1 AS INTEGER) AS since FROM r)
SELECT iteration, round(reward, 6) AS reward, round(best, 6) AS best, improved, since, since >= 5 AS stop FROM s""", "history")
def lb10_best_so_far(spark, d):
    return rounded(leaderboard.best_so_far(_history(spark, d)))
