"""Queries of metrics, sweeps, ranking curves, calibration and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.conditions import condition_label
from ..operators import calibration, curves, joins, metrics, ranking, stats, thresholds
from .base import query
from .roles import role
from .scalars import _COND, LABEL_SQL


def rounded(df, digits: int = 6, *skip: str):
    """Doubles rounded: sums of doubles depend on their order."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" and c not in skip else F.col(c) for c, kind in df.dtypes])


def _preds(spark, d):
    return role(spark, d, "preds")


_POS = "coalesce(avg(CASE WHEN ground_truth = 'SPEECH' THEN CAST(correct AS INTEGER) END), 0)"
_NEG = "coalesce(avg(CASE WHEN ground_truth = 'NONSPEECH' THEN CAST(correct AS INTEGER) END), 0)"
_BA = f"round(({_POS} + {_NEG}) / 2, 6) AS ba, round({_POS}, 6) AS acc_pos, round({_NEG}, 6) AS acc_neg"
_N = "count(*) AS n, sum(CASE WHEN ground_truth = 'SPEECH' THEN 1 ELSE 0 END)::BIGINT AS n_pos, sum(CASE WHEN ground_truth = 'NONSPEECH' THEN 1 ELSE 0 END)::BIGINT AS n_neg"


@query(f"SELECT run, count(*) AS n, sum(CAST(correct AS INTEGER))::BIGINT AS n_correct, round(avg(CAST(correct AS INTEGER)), 6) AS accuracy, round({_POS}, 6) AS acc_pos, round({_NEG}, 6) AS acc_neg FROM preds GROUP BY run", "preds")
def mt01_accuracy_table(spark, d):
    return rounded(metrics.accuracy_table(_preds(spark, d), ["run"]))


@query(f"SELECT run, {_BA}, {_N} FROM preds GROUP BY run", "preds")
def mt02_balanced_accuracy(spark, d):
    return rounded(metrics.balanced_accuracy(_preds(spark, d), ["run"]))


_LONG = "SELECT 'duration' AS dimension, CAST(duration_ms AS STRING) AS value, ground_truth, correct FROM preds UNION ALL SELECT 'snr', CAST(snr_db AS STRING), ground_truth, correct FROM preds UNION ALL SELECT 'filter', band_filter, ground_truth, correct FROM preds UNION ALL SELECT 'reverb', t60_bin, ground_truth, correct FROM preds"


@query(f"WITH u AS ({_LONG}), c AS (SELECT dimension, value, ({_POS} + {_NEG}) / 2 AS ba FROM u WHERE value IS NOT NULL GROUP BY 1, 2) SELECT dimension, count(*) AS n_values, round(avg(ba), 6) AS macro_ba FROM c GROUP BY 1", "preds")
def mt03_macro_over_conditions(spark, d):
    return rounded(metrics.macro_over_conditions(_preds(spark, d)))


def _wilson_sql(k, n, z):
    p, nn = f"({k} / CAST({n} AS DOUBLE))", f"CAST({n} AS DOUBLE)"
    centre = f"({p} + {z * z!r}::DOUBLE / (2 * {nn})) / (1 + {z * z!r}::DOUBLE / {nn})"
    half = f"{z!r}::DOUBLE * sqrt({p} * (1 - {p}) / {nn} + {z * z!r}::DOUBLE / (4 * {nn} * {nn})) / (1 + {z * z!r}::DOUBLE / {nn})"
    return f"round(greatest({centre} - {half}, 0), 6)", f"round(least({centre} + {half}, 1), 6)"


_LO, _HI = _wilson_sql("n_correct", "n", 1.96)


@query(f"""WITH g AS (SELECT dur, snr, ground_truth, grouping_id(dur, snr, ground_truth) AS level, count(*) AS n, sum(CAST(correct AS INTEGER))::BIGINT AS n_correct FROM preds
  GROUP BY GROUPING SETS ((dur), (snr), (ground_truth), (dur, ground_truth), (snr, ground_truth), (dur, snr), ()))
SELECT *, round(100.0 * n_correct / n, 6)::DOUBLE AS accuracy_pct, {_LO} AS ci_low, {_HI} AS ci_high FROM g""", "preds")
def mt04_metrics_by_condition(spark, d):
    return rounded(metrics.metrics_by_condition(_preds(spark, d), ("dur", "snr", "ground_truth")))


@query(f"WITH g AS (SELECT run, count(*) AS n, sum(CAST(correct AS INTEGER))::BIGINT AS n_correct FROM preds GROUP BY run) SELECT *, {_LO} AS ci_low, {_HI} AS ci_high FROM g", "preds")
def mt05_wilson_interval(spark, d):
    t = metrics.accuracy_table(_preds(spark, d), ["run"]).select("run", "n", "n_correct")
    return rounded(metrics.wilson_interval(t))


@query(f"WITH c AS (SELECT *, {LABEL_SQL} AS condition FROM preds) SELECT variant_type, condition, grouping_id(variant_type, condition) AS level, {_BA}, {_N} FROM c GROUP BY ROLLUP (variant_type, condition)", "preds")
def mt06_condition_metrics(spark, d):
    p = _preds(spark, d).withColumn("condition", condition_label(*[F.col(c) for c in _COND]))
    return rounded(metrics.condition_metrics(p))


def _sweep_sql(by, start, step, n, op):
    """Confusion counts by threshold over rows grouped by score first."""
    g = "".join(f"{b}, " for b in by)
    on = " AND ".join(["TRUE", *[f"c.{b} = t.{b}" for b in by]])
    return f"""c AS (SELECT {g}score, sum(CASE WHEN ground_truth = 'SPEECH' THEN 1 ELSE 0 END) AS p, sum(CASE WHEN ground_truth = 'SPEECH' THEN 0 ELSE 1 END) AS q FROM preds GROUP BY {g}score),
s AS (SELECT {''.join(f'c.{b}, ' for b in by)}i.i AS index, {start}::DOUBLE + i.i * {step}::DOUBLE AS threshold,
  sum(CASE WHEN score {op} {start}::DOUBLE + i.i * {step}::DOUBLE THEN p ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN score {op} {start}::DOUBLE + i.i * {step}::DOUBLE THEN q ELSE 0 END)::BIGINT AS fp, sum(p)::BIGINT AS ap, sum(q)::BIGINT AS aq
  FROM c, range({n}) AS i(i) GROUP BY {''.join(f'c.{b}, ' for b in by)}i.i),
k AS (SELECT {g}index, threshold, tp, fp, ap - tp AS fn, aq - fp AS tn FROM s)"""


@query(f"""WITH {_sweep_sql([], 0.0, 0.01, 101, '>=')},
m AS (SELECT CAST(index AS INTEGER) AS index, threshold, tp, fp, fn, tn, (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE) AS accuracy, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1, CASE WHEN tn + fp = 0 THEN 0 ELSE tn / CAST(tn + fp AS DOUBLE) END AS specificity FROM k)
SELECT index, round(threshold, 6) AS threshold, tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(specificity, 6) AS specificity, row_number() OVER (ORDER BY f1 DESC, index) = 1 AS best FROM m""", "preds")
def mt07_confusion_at_thresholds(spark, d):
    return rounded(thresholds.confusion_at_thresholds(_preds(spark, d)))


@query(f"""WITH {_sweep_sql(['variant_type'], 0.1, 0.01, 85, '>')},
b AS (SELECT variant_type, index, threshold, tp + fn + fp + tn AS n, coalesce((CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) END + CASE WHEN tn + fp > 0 THEN tn / CAST(tn + fp AS DOUBLE) END) / 2, 0) AS ba FROM k)
SELECT variant_type, max(n) AS n, CAST(arg_min(index, {{'a': -ba, 'i': index}}) AS INTEGER) AS best_index, round(arg_min(threshold, {{'a': -ba, 'i': index}}), 6) AS best_threshold, round(max(ba), 6) AS best_ba FROM b GROUP BY 1""", "preds")
def mt08_sweep_threshold(spark, d):
    return rounded(thresholds.sweep_threshold(_preds(spark, d), by=["variant_type"], min_rows=10))


_BEST = "coalesce((CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) END + CASE WHEN tn + fp > 0 THEN tn / CAST(tn + fp AS DOUBLE) END) / 2, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) END, CASE WHEN tn + fp > 0 THEN tn / CAST(tn + fp AS DOUBLE) END, 0)"


@query(f"""WITH {_sweep_sql([], 0.1, 0.01, 85, '>')}, b AS (SELECT index, threshold, tp + fn + fp + tn AS n, {_BEST} AS ba FROM k)
SELECT max(n) AS n, CAST(arg_min(index, {{'a': -ba, 'i': index}}) AS INTEGER) AS best_index, round(arg_min(threshold, {{'a': -ba, 'i': index}}), 6) AS best_threshold, round(max(ba), 6) AS best_ba FROM b""", "preds")
def mt08_sweep_threshold_globally(spark, d):
    return rounded(thresholds.sweep_threshold(_preds(spark, d)))


@query(f"""WITH {_sweep_sql(['variant_type', 'dur', 'snr'], 0.1, 0.01, 85, '>')}, b AS (SELECT variant_type, dur, snr, index, threshold, tp + fn + fp + tn AS n, {_BEST} AS ba FROM k)
SELECT variant_type, dur, snr, max(n) AS n, CAST(CASE WHEN max(ba) > 0 THEN arg_min(index, {{'a': -ba, 'i': index}}) END AS INTEGER) AS best_index, round(CASE WHEN max(ba) > 0 THEN arg_min(threshold, {{'a': -ba, 'i': index}}) ELSE 0.5 END, 6) AS best_threshold, round(max(ba), 6) AS best_ba FROM b GROUP BY 1, 2, 3 HAVING max(n) >= 10""", "preds")
def mt08_sweep_threshold_by_condition(spark, d):
    """Conditions of ten rows or more."""
    return rounded(thresholds.sweep_threshold(_preds(spark, d), by=["variant_type", "dur", "snr"], min_rows=10))



@query(f"""WITH q AS (SELECT ground_truth, logit_diff AS score FROM preds), {_sweep_sql([], -10.0, '(20.0::DOUBLE / 199)', 200, '>').replace('FROM preds', 'FROM q')},
z AS (SELECT CAST(index AS INTEGER) AS index, threshold, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS pos, CASE WHEN tn + fp > 0 THEN tn / CAST(tn + fp AS DOUBLE) ELSE 0 END AS neg, (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE) AS overall FROM k),
l AS (SELECT index, threshold, 'min_class' AS objective, least(pos, neg) AS v FROM z UNION ALL SELECT index, threshold, 'positive', pos FROM z UNION ALL SELECT index, threshold, 'negative', neg FROM z UNION ALL SELECT index, threshold, 'overall', overall FROM z),
b AS (SELECT objective, arg_min(index, {{'a': -v, 'i': index}}) AS best_index, arg_min(threshold, {{'a': -v, 'i': index}}) AS threshold, max(v) AS value FROM l GROUP BY 1),
e AS (SELECT avg(CASE WHEN ground_truth = 'SPEECH' THEN CAST(score > 0 AS INTEGER) END) AS pos, avg(CASE WHEN ground_truth <> 'SPEECH' THEN CAST(score <= 0 AS INTEGER) END) AS neg, avg(CAST((score > 0) = (ground_truth = 'SPEECH') AS INTEGER)) AS overall FROM q),
f AS (SELECT 'min_class' AS objective, least(pos, neg) AS baseline FROM e UNION ALL SELECT 'positive', pos FROM e UNION ALL SELECT 'negative', neg FROM e UNION ALL SELECT 'overall', overall FROM e)
SELECT objective, best_index, round(threshold, 6) AS threshold, round(value, 6) AS value, round(baseline, 6) AS baseline, round(value - baseline, 6) AS delta FROM b JOIN f USING (objective)""", "preds")
def mt09_sweep_logit_threshold(spark, d):
    return rounded(thresholds.sweep_logit_threshold(_preds(spark, d)))


_CUM = """c AS (SELECT run, score, sum(CASE WHEN ground_truth = 'SPEECH' THEN 1 ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN ground_truth = 'SPEECH' THEN 0 ELSE 1 END)::DOUBLE AS q FROM preds GROUP BY 1, 2),
k AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY run) AS ap, sum(q) OVER (PARTITION BY run) AS aq FROM c WINDOW w AS (PARTITION BY run ORDER BY score DESC))"""


@query(f"WITH {_CUM} SELECT run, round(sum(p * (aq - fp + q / 2)) / max(ap * aq), 6) AS auc FROM k GROUP BY run", "preds")
def mt10_roc_auc(spark, d):
    return rounded(ranking.roc_auc(_preds(spark, d), ["run"]))


@query(f"WITH {_CUM} SELECT run, round(sum(p / ap * tp / (tp + fp)), 6) AS ap FROM k GROUP BY run", "preds")
def mt11_average_precision(spark, d):
    return rounded(ranking.average_precision(_preds(spark, d), ["run"]))


@query(f"WITH {_CUM} SELECT run, score AS threshold, round(fp / aq, 6) AS fpr, round(tp / ap, 6) AS tpr FROM k", "preds")
def mt12_roc_curve(spark, d):
    return rounded(ranking.roc_curve(_preds(spark, d), ["run"]))


@query(f"WITH {_CUM} SELECT run, score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / ap, 6) AS recall, round(ap / (ap + aq), 6) AS prevalence FROM k", "preds")
def mt12_pr_curve(spark, d):
    return rounded(ranking.pr_curve(_preds(spark, d), ["run"]))


@query(f"WITH {_CUM}, r AS (SELECT run, score, tp / ap AS r, tp / (tp + fp) AS p FROM k), t AS (SELECT run, (r - coalesce(lag(r) OVER w, 0)) * (p + coalesce(lag(p) OVER w, 1)) / 2 AS a FROM r WINDOW w AS (PARTITION BY run ORDER BY score DESC)) SELECT run, round(sum(a), 6) AS pr_auc FROM t GROUP BY run", "preds")
def mt12_pr_auc(spark, d):
    return rounded(ranking.pr_auc(_preds(spark, d), ["run"]))


@query()
def mt13_bootstrap_auc(spark, d):
    return rounded(stats.bootstrap_auc(_preds(spark, d), n=200))


@query()
def mt14_bootstrap_accuracy(spark, d):
    return rounded(stats.bootstrap_accuracy(_preds(spark, d), ["run"]))


@query()
def mt15_bootstrap_mean(spark, d):
    return rounded(stats.bootstrap_mean(metrics.accuracy_table(_preds(spark, d), ["run"]), "accuracy"))


_FIRST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def paired_runs(spark, d):
    p = joins.first_per_key(_preds(spark, d).filter("run in (1, 2)"), ["clip_id", "run"], _FIRST).select("clip_id", "run", "ground_truth", "prediction", "correct", "score")
    one, two = (p.filter(F.col("run") == r).drop("run") for r in (1, 2))
    return one, two


PAIR_SQL = """f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, run ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM preds WHERE run IN (1, 2)) WHERE rn = 1),
pair AS (SELECT a.clip_id, a.ground_truth AS ground_truth_a, a.prediction AS prediction_a, a.correct AS correct_a, a.score AS score_a, b.ground_truth AS ground_truth_b, b.prediction AS prediction_b, b.correct AS correct_b, b.score AS score_b FROM f a JOIN f b ON a.clip_id = b.clip_id AND a.run = 1 AND b.run = 2)"""


@query(f"WITH {PAIR_SQL} SELECT count(*) FILTER (correct_a AND correct_b) AS n11, count(*) FILTER (correct_a AND NOT correct_b) AS n10, count(*) FILTER (NOT correct_a AND correct_b) AS n01, count(*) FILTER (NOT correct_a AND NOT correct_b) AS n00 FROM pair", "preds")
def mt16_mcnemar_counts(spark, d):
    return stats.mcnemar_counts(joins.pair_predictions(*paired_runs(spark, d), ["clip_id"]))


@query(f"""WITH {PAIR_SQL}, c AS (SELECT count(*) FILTER (correct_a AND correct_b) AS n11, count(*) FILTER (correct_a AND NOT correct_b) AS n10, count(*) FILTER (NOT correct_a AND correct_b) AS n01, count(*) FILTER (NOT correct_a AND NOT correct_b) AS n00 FROM pair)
SELECT round((abs(n10 - n01) - 1)::DOUBLE * (abs(n10 - n01) - 1) / (n01 + n10), 6) AS chi2, round((n10 - n01) / CAST(n01 + n10 AS DOUBLE), 6) AS effect, round((n10 - n01) / sqrt(n01 + n10), 6) AS cohen_g FROM c""", "preds")
def mt16_mcnemar_statistic(spark, d):
    return rounded(stats.mcnemar(joins.pair_predictions(*paired_runs(spark, d), ["clip_id"])).select("chi2", "effect", "cohen_g"))


@query(f"""WITH {PAIR_SQL}, c AS (SELECT count(*) FILTER (correct_a AND correct_b) AS n11, count(*) FILTER (correct_a AND NOT correct_b) AS n10, count(*) FILTER (NOT correct_a AND correct_b) AS n01, count(*) FILTER (NOT correct_a AND NOT correct_b) AS n00 FROM pair),
t AS (SELECT *, (abs(n10 - n01) - 1)::DOUBLE * (abs(n10 - n01) - 1) / (n01 + n10) AS chi2 FROM c),
-- The tail is one less twice the normal density's integral from 0 to the root of chi2, by Simpson's rule.
p AS (SELECT 1 - 2 * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-chi2 * (i / 4000.0::DOUBLE) * (i / 4000.0::DOUBLE) / 2)) * sqrt(chi2) / 12000 / sqrt(2 * pi()) AS p FROM t, range(4001) AS r(i) GROUP BY chi2)
SELECT n11, n10, n01, n00, round(chi2, 6) AS chi2, round(p, 6) AS p_value, round((n10 - n01) / CAST(n01 + n10 AS DOUBLE), 6) AS effect, round((n10 - n01) / sqrt(n01 + n10), 6) AS cohen_g FROM t, p""", "preds")
def mt16_mcnemar(spark, d):
    return rounded(stats.mcnemar(joins.pair_predictions(*paired_runs(spark, d), ["clip_id"])))


@query()
def mt17_compare_models(spark, d):
    return rounded(stats.compare_models(joins.pair_predictions(*paired_runs(spark, d), ["clip_id"])))


@query("""WITH c AS (SELECT dur AS a, correct AS b, count(*)::DOUBLE AS o FROM preds GROUP BY 1, 2), t AS (SELECT a, b, o, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM c),
s AS (SELECT sum((o - e) * (o - e) / e) AS x, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS k FROM t),
-- The tail is one less the density's integral from 0 to chi2, by Simpson's rule.
p AS (SELECT x, k, 1 - sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(x * i / 4000, k / 2 - 1) * exp(-x * i / 8000 - k / 2 * ln(2) - lgamma(k / 2))) * x / 12000 AS p FROM s, range(4001) AS r(i) GROUP BY x, k)
SELECT round(x, 6) AS chi2, CAST(k AS INTEGER) AS dof, round(p, 6) AS p_value FROM p""", "preds")
def mt18_chi2_independence(spark, d):
    return rounded(stats.chi2_independence(_preds(spark, d).withColumn("c", F.col("correct").cast("string")), "dur", "c"))


@query("""WITH c AS (SELECT dur AS a, correct AS b, count(*)::DOUBLE AS o FROM preds GROUP BY 1, 2), t AS (SELECT o, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM c)
SELECT round(sum((o - e) * (o - e) / e), 6) AS chi2 FROM t""", "preds")
def mt18_chi2_statistic(spark, d):
    return rounded(stats.chi2_independence(_preds(spark, d).withColumn("c", F.col("correct").cast("string")), "dur", "c").select("chi2"))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY dur) + (count(*) OVER (PARTITION BY dur) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS b FROM preds),
s AS (SELECT count(*) AS n, corr(a, b) AS rho FROM r), t AS (SELECT n, rho, (n - 2)::DOUBLE AS v, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) AS t FROM s),
-- The tail is one less twice the density's integral from 0 to t, by Simpson's rule.
p AS (SELECT n, rho, 1 - 2 * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + (t * i / 4000) * (t * i / 4000) / v, -(v + 1) / 2)) * t / 12000 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) AS p FROM t, range(4001) AS r(i) GROUP BY n, rho, v, t)
SELECT n, round(rho, 6) AS rho, round(p, 6) AS p_value FROM p""", "preds")
def mt19_spearman(spark, d):
    return rounded(stats.spearman(_preds(spark, d), "dur", "score"))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY dur) + (count(*) OVER (PARTITION BY dur) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS b FROM preds)
SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r""", "preds")
def mt19_spearman_rho(spark, d):
    return rounded(stats.spearman(_preds(spark, d), "dur", "score").select("n", "rho"))


_BIN = "CASE " + " ".join(f"WHEN score >= {i / 10!r}::DOUBLE AND score < {(i + 1) / 10!r}::DOUBLE THEN {i}" for i in range(10)) + " END"


@query(f"WITH b AS (SELECT {_BIN} AS bin, score, correct FROM preds), c AS (SELECT bin, count(*) AS n, avg(score) AS m, avg(CAST(correct AS INTEGER)) AS r FROM b GROUP BY 1) SELECT round(sum(CASE WHEN bin IS NULL THEN 0 ELSE abs(m - r) * n END) / sum(n), 6) AS ece FROM c", "preds")
def mt20_ece(spark, d):
    return rounded(calibration.ece(_preds(spark, d), prob="score"))


@query(f"WITH b AS (SELECT {_BIN} AS bin, score, correct FROM preds) SELECT bin, count(*) AS n, round(avg(score), 6) AS mean_prob, round(avg(CAST(correct AS INTEGER)), 6) AS share_correct FROM b WHERE bin IS NOT NULL GROUP BY 1", "preds")
def mt20_reliability_bins(spark, d):
    return rounded(calibration.reliability_bins(_preds(spark, d), prob="score"))


@query("SELECT run, round(avg((score - CASE WHEN ground_truth = 'SPEECH' THEN 1 ELSE 0 END) * (score - CASE WHEN ground_truth = 'SPEECH' THEN 1 ELSE 0 END)), 6) AS brier FROM preds GROUP BY run", "preds")
def mt21_brier(spark, d):
    return rounded(calibration.brier(_preds(spark, d), "score", ["run"]))


_TBIN = _BIN.replace("score", "prob")



def _errors_sql(name: str, brackets: str, steps: int) -> str:
    """Errors at the points of brackets (f, l), as the operator takes them."""
    return f"""{name} AS MATERIALIZED (WITH p AS (SELECT f, l, i, f + i * (l - f) / {float(max(steps, 1))!r}::DOUBLE AS t FROM {brackets}, range({steps + 1}) AS x(i)),
  q AS (SELECT p.*, w, y, 1 / (1 + exp(-logit_diff / t)) AS prob FROM v, p),
  b AS (SELECT f, l, i, t, {_TBIN} AS bin, sum(w) AS n, sum(prob * w) AS sp, sum(CASE WHEN (prob >= 0.5) = (y = 1) THEN w ELSE 0 END) AS sc, sum((prob - y) * (prob - y) * w) AS sb FROM q GROUP BY 1, 2, 3, 4, 5)
  SELECT f, l, i, t, sum(CASE WHEN bin IS NULL THEN 0 ELSE abs(sp - sc) END) / sum(n) AS ece, sum(sb) / sum(n) AS brier FROM b GROUP BY 1, 2, 3, 4)"""


def _brackets_sql(name: str, errors: str, steps: int) -> str:
    """Brackets of one step around the three best local minima."""
    return f"""{name} AS MATERIALIZED (SELECT DISTINCT greatest(0.1::DOUBLE, t - (l - f) / {float(steps)!r}::DOUBLE) AS f, least(10.0::DOUBLE, t + (l - f) / {float(steps)!r}::DOUBLE) AS l FROM (SELECT *, round(ece, 9) AS e, lag(round(ece, 9)) OVER w AS bf, lead(round(ece, 9)) OVER w AS af FROM {errors} WINDOW w AS (PARTITION BY f, l ORDER BY i))
  WHERE (bf IS NULL OR e <= bf) AND (af IS NULL OR e <= af) QUALIFY row_number() OVER (ORDER BY e, t, i) <= 3)"""


@query(f"""WITH v AS (SELECT CASE WHEN ground_truth = 'SPEECH' THEN 1 ELSE 0 END AS y, logit_diff, count(*) AS w FROM preds GROUP BY 1, 2),
one AS (SELECT 1.0::DOUBLE AS f, 1.0::DOUBLE AS l), r0 AS (SELECT 0.1::DOUBLE AS f, 10.0::DOUBLE AS l), {_errors_sql('e1', 'one', 0)}, {_errors_sql('a0', 'r0', 99)},
{_brackets_sql('r1', 'a0', 99)}, {_errors_sql('a1', 'r1', 10)}, {_brackets_sql('r2', 'a1', 10)}, {_errors_sql('a2', 'r2', 10)}, {_brackets_sql('r3', 'a2', 10)}, {_errors_sql('a3', 'r3', 10)},
u AS (SELECT t, ece, brier FROM a0 UNION ALL SELECT t, ece, brier FROM a1 UNION ALL SELECT t, ece, brier FROM a2 UNION ALL SELECT t, ece, brier FROM a3),
z AS (SELECT t, ece, brier FROM u ORDER BY round(ece, 9), t LIMIT 1)
SELECT round(z.t, 6) AS temperature, round(e1.ece, 6) AS ece_before, round(z.ece, 6) AS ece_after, round(e1.brier, 6) AS brier_before, round(z.brier, 6) AS brier_after FROM z, e1""", "preds")
def mt22_find_temperature(spark, d):
    return rounded(calibration.find_temperature(_preds(spark, d)))


@query("SELECT snr, dur AS x, count(*) AS n, sum(CAST(correct AS INTEGER))::BIGINT AS n_correct, round(100.0 * sum(CAST(correct AS INTEGER)) / count(*), 6)::DOUBLE AS accuracy_pct FROM preds WHERE dur IN (20, 80, 200, 1000) GROUP BY 1, 2", "preds")
def mt23_accuracy_curve(spark, d):
    return rounded(curves.accuracy_curve(_preds(spark, d).filter("dur in (20, 80, 200, 1000)"), "dur", ["snr"]))


@query("""WITH c AS (SELECT run, dur AS x, 100.0::DOUBLE * sum(CAST(correct AS INTEGER)) / count(*) AS y FROM preds GROUP BY 1, 2), l AS (SELECT *, lead(y) OVER w AS y2, lead(x) OVER w AS x2 FROM c WINDOW w AS (PARTITION BY run ORDER BY y, x)),
k AS (SELECT run, min(y) AS lo, max(y) AS hi, arg_min(CASE WHEN y <= 50 AND y2 > 50 THEN x + (50 - y) / (y2 - y) * (x2 - x) END, CASE WHEN y <= 50 AND y2 > 50 THEN y END) AS t FROM l GROUP BY run)
SELECT run, CASE WHEN lo < 50 AND hi > 50 THEN round(t, 6) END AS threshold FROM k""", "preds")
def mt24_curve_threshold(spark, d):
    curve = curves.accuracy_curve(_preds(spark, d), "dur", ["run"])
    return rounded(curves.curve_threshold(curve, 50.0, ["run"]))


@query("""WITH c AS (SELECT dur AS x, clip_id, 100.0::DOUBLE * sum(CAST(correct AS INTEGER)) / count(*) AS y FROM preds GROUP BY 1, 2), l AS (SELECT *, lead(y) OVER w AS y2, lead(x) OVER w AS x2 FROM c WINDOW w AS (PARTITION BY clip_id ORDER BY y, x)), g AS (SELECT *, unnest([75.0::DOUBLE, 90.0::DOUBLE]) AS target FROM l),
k AS (SELECT clip_id, target, min(y) AS lo, max(y) AS hi, arg_min(CASE WHEN y <= target AND y2 > target THEN x + (target - y) / (y2 - y) * (x2 - x) END, CASE WHEN y <= target AND y2 > target THEN y END) AS t FROM g GROUP BY 1, 2)
SELECT clip_id, target, CASE WHEN lo < target AND hi > target THEN round(t, 6) END AS threshold FROM k""", "preds")
def mt24_curve_thresholds_75_90(spark, d):
    """Durations at which 75 and 90 % are right, clip by clip; null where a curve does not cross."""
    return rounded(curves.thresholds_of_many(_preds(spark, d), "dur", [75.0, 90.0], ["clip_id"]))


@query()
def mt25_bootstrap_curve_threshold(spark, d):
    return rounded(curves.bootstrap_curve_threshold(_preds(spark, d), "dur", 50.0, 300))


@query()
def mt26_fit_psychometric(spark, d):
    return rounded(curves.fit_psychometric(_preds(spark, d), "dur", ["run"]), 4)


@query("""WITH v AS (SELECT clip_id, min(ground_truth) AS ground_truth, sum(CASE WHEN prediction = 'SPEECH' THEN 1 ELSE 0 END) AS y, count(*) AS n_votes FROM preds GROUP BY clip_id), p AS (SELECT *, CASE WHEN y * 2 >= n_votes THEN 'SPEECH' ELSE 'NONSPEECH' END AS prediction FROM v)
SELECT clip_id, ground_truth, prediction, ground_truth = prediction AS correct, n_votes FROM p""", "preds")
def mt27_clip_vote(spark, d):
    return metrics.clip_vote(_preds(spark, d))


@query("""WITH v AS (SELECT run, clip_id, min(ground_truth) AS ground_truth, CASE WHEN sum(CASE WHEN prediction = 'SPEECH' THEN 1 ELSE 0 END) * 2 >= count(*) THEN 'SPEECH' ELSE 'NONSPEECH' END AS prediction FROM preds GROUP BY 1, 2),
c AS (SELECT run, count(*) AS n_clips, count(*) FILTER (ground_truth = 'SPEECH' AND prediction = 'SPEECH')::DOUBLE AS tp, count(*) FILTER (ground_truth <> 'SPEECH' AND prediction = 'SPEECH')::DOUBLE AS fp, count(*) FILTER (ground_truth = 'SPEECH' AND prediction <> 'SPEECH')::DOUBLE AS fn, count(*) FILTER (ground_truth <> 'SPEECH' AND prediction <> 'SPEECH')::DOUBLE AS tn FROM v GROUP BY 1)
SELECT run, n_clips, round((tp + tn) / n_clips, 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS ba, round(tp / (tp + fn), 6) AS acc_pos, round(tn / (tn + fp), 6) AS acc_neg, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) AS macro_f1 FROM c""", "preds")
def mt27_clip_metrics(spark, d):
    return rounded(metrics.clip_metrics(_preds(spark, d), ["run"]))


@query("""WITH c AS (SELECT run, count(*) FILTER (ground_truth = 'SPEECH' AND prediction = 'SPEECH') AS tp, count(*) FILTER (ground_truth <> 'SPEECH' AND prediction = 'SPEECH') AS fp, count(*) FILTER (ground_truth = 'SPEECH' AND prediction <> 'SPEECH') AS fn, count(*) FILTER (ground_truth <> 'SPEECH' AND prediction <> 'SPEECH') AS tn FROM preds GROUP BY run),
f AS (SELECT run, coalesce(2.0::DOUBLE * tp / (2 * tp + fp + fn), 0) AS a, coalesce(2.0::DOUBLE * tn / (2 * tn + fp + fn), 0) AS b FROM c) SELECT run, round(a, 6) AS f1_pos, round(b, 6) AS f1_neg, round((a + b) / 2, 6) AS macro_f1 FROM f""", "preds")
def mt28_macro_f1(spark, d):
    return rounded(metrics.macro_f1(_preds(spark, d), ["run"]))


@query(f"""WITH b AS (SELECT ({_POS} + {_NEG}) / 2 AS ba_base FROM preds WHERE run = 1), w AS (SELECT ({_POS} + {_NEG}) / 2 AS ba_new, avg(CASE WHEN prediction NOT IN ('SPEECH', 'NONSPEECH') THEN 1 ELSE 0 END) AS unknown_rate FROM preds WHERE run = 2),
s AS (SELECT duration_ms, ({_POS} + {_NEG}) / 2 AS ba FROM preds WHERE run = 2 AND duration_ms IS NOT NULL GROUP BY 1), t AS (SELECT ba, lead(ba) OVER (ORDER BY duration_ms) AS nx FROM s), m AS (SELECT coalesce(avg(CASE WHEN nx >= ba THEN 1 ELSE 0 END), 1) AS monotone_share FROM t WHERE nx IS NOT NULL)
SELECT round(ba_base, 6) AS ba_base, round(ba_new, 6) AS ba_new, round(unknown_rate, 6)::DOUBLE AS unknown_rate, round(monotone_share, 6) AS monotone_share, ba_new - ba_base >= 0.02 AS gain_ok, TRUE AS constrained_ok, unknown_rate < 0.05 AS unknown_ok, monotone_share >= 0.7 AS monotone_ok,
  ba_new - ba_base >= 0.02 AND unknown_rate < 0.05 AND monotone_share >= 0.7 AS passed FROM b, w, m""", "preds")
def mt29_gate_check(spark, d):
    p = _preds(spark, d)
    return rounded(metrics.gate_check(p.filter("run = 1"), p.filter("run = 2"), 0.8, 0.8))


@query("""SELECT run, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, min(score) AS min, max(score) AS max, round(avg(CASE WHEN correct THEN score END), 6) AS mean_correct, round(avg(CASE WHEN NOT correct THEN score END), 6) AS mean_wrong,
  round(avg(CASE WHEN correct THEN score END) - avg(CASE WHEN NOT correct THEN score END), 6) AS gap FROM preds GROUP BY run""", "preds")
def mt30_score_summary(spark, d):
    return rounded(metrics.score_summary(_preds(spark, d), ["run"]))


@query("""WITH e AS (SELECT min(score) AS lo, max(score) AS hi FROM preds), b AS (SELECT ground_truth, CAST(least(floor((score - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, (hi - lo) / 30 AS w FROM preds, e), c AS (SELECT ground_truth, bin, count(*) AS n, max(w) AS w FROM b GROUP BY 1, 2)
SELECT ground_truth, bin, n, round(n / sum(n) OVER (PARTITION BY ground_truth) / w, 6) AS density FROM c""", "preds")
def mt31_score_distribution(spark, d):
    return rounded(metrics.score_distribution(_preds(spark, d)))


@query("SELECT ground_truth, round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.75), 6) AS q75 FROM preds GROUP BY 1", "preds")
def mt31_score_quartiles(spark, d):
    return rounded(metrics.score_quartiles(_preds(spark, d)))


@query("SELECT snr, round(avg(CASE WHEN ground_truth = 'SPEECH' THEN score END), 6) AS mean_pos, round(avg(CASE WHEN ground_truth = 'NONSPEECH' THEN score END), 6) AS mean_neg, round(avg(CASE WHEN ground_truth = 'SPEECH' THEN score END) - avg(CASE WHEN ground_truth = 'NONSPEECH' THEN score END), 6) AS separation FROM preds GROUP BY 1", "preds")
def mt32_class_separation(spark, d):
    return rounded(metrics.class_separation(_preds(spark, d), ["snr"]))


@query("""WITH u AS (SELECT DISTINCT clip_id, snr, CAST(correct AS INTEGER) AS c, round(score, 6) AS s FROM preds), g AS (SELECT clip_id, max(c) = 1 AS has, min(c) = 1 AS al, string_agg(concat(snr, '=', c), ',' ORDER BY snr, c, s) AS pattern FROM u GROUP BY 1)
SELECT clip_id, NOT has AS always_wrong, has AS flips, pattern FROM g WHERE NOT al""", "preds")
def mt33_error_patterns(spark, d):
    return _patterns(spark, d).drop("scores")


@query("""WITH u AS (SELECT clip_id, snr, bool_and(correct) AS al, avg(score) AS s FROM preds GROUP BY 1, 2)
SELECT clip_id, string_agg(concat(snr, ':', CAST(round(s * 1000) AS INTEGER)), ',' ORDER BY snr) AS scores FROM u GROUP BY 1 HAVING NOT bool_and(al)""", "preds")
def mt33_scores_of_patterns(spark, d):
    text = F.transform(F.array_sort(F.map_keys("scores")), lambda k: F.concat_ws(":", k.cast("string"), F.round(F.try_element_at("scores", k) * 1000).cast("int").cast("string")))
    return _patterns(spark, d).select("clip_id", F.array_join(text, ",").alias("scores"))


def _patterns(spark, d):
    return metrics.error_patterns(_preds(spark, d), "clip_id", "snr")


def _cls(label, here):
    return f"round(avg(CASE WHEN {here} AND ground_truth = '{label}' THEN CAST(correct AS INTEGER) END), 6)"


@query(f"""WITH r AS (SELECT {_cls('SPEECH', 'snr <= 0')} AS acc_pos_low, {_cls('NONSPEECH', 'snr <= 0')} AS acc_neg_low, avg(CASE WHEN snr <= 0 AND ground_truth = 'SPEECH' THEN score END) AS a,
  {_cls('SPEECH', 'snr >= 10')} AS acc_pos_high, {_cls('NONSPEECH', 'snr >= 10')} AS acc_neg_high, avg(CASE WHEN snr >= 10 AND ground_truth = 'SPEECH' THEN score END) AS b FROM preds)
SELECT acc_pos_low, acc_neg_low, round(a, 6) AS score_low, acc_pos_high, acc_neg_high, round(b, 6) AS score_high, a < b AS confirmed FROM r""", "preds")
def mt34_low_high_contrast(spark, d):
    return rounded(metrics.low_high_contrast(_preds(spark, d), "snr"))


@query(f"WITH c AS (SELECT dur, snr, round(({_POS} + {_NEG}) / 2, 6) AS ba FROM preds GROUP BY 1, 2) SELECT dur" + "".join(f", max(CASE WHEN snr = {s} THEN ba END) AS \"{s}\"" for s in range(-10, 21, 3)) + " FROM c GROUP BY dur", "preds")
def mt35_condition_matrix(spark, d):
    return rounded(metrics.condition_matrix(_preds(spark, d), "dur", "snr", list(range(-10, 21, 3))))


_SNR = tuple(range(-10, 21, 3))  # all that the role has


@query(f"WITH c AS (SELECT dur, snr, round(({_POS} + {_NEG}) / 2, 6) AS ba FROM preds GROUP BY 1, 2) SELECT dur" + "".join(f", max(CASE WHEN snr = {s} THEN ba END) AS \"{s}\"" for s in _SNR) + " FROM c GROUP BY dur", "preds")
def mt35_condition_matrix_all_snr(spark, d):
    return rounded(metrics.condition_matrix(_preds(spark, d), "dur", "snr", list(_SNR)))


@query("SELECT clip_id, run, ground_truth, prediction, score FROM preds WHERE NOT correct", "preds")
def mt36_errors(spark, d):
    return metrics.errors(_preds(spark, d)).select("clip_id", "run", "ground_truth", "prediction", "score")


_VAD = "SELECT vec_id AS clip_id, abs(CAST(u AS DOUBLE)) * 3 AS prob FROM (SELECT vec_id, unnest(embedding) AS u FROM embeddings)"


@query(f"""WITH v AS ({_VAD}), g AS (SELECT clip_id, count(*) AS n_frames, count(*) FILTER (prob >= 0.5) AS n_speech, avg(prob) AS a, min(prob) AS lo, max(prob) AS hi FROM v GROUP BY 1)
SELECT clip_id, n_frames, n_speech, round(a, 6) AS mean_prob, round(lo, 6) AS min_prob, round(hi, 6) AS max_prob, CASE WHEN n_speech > 0 THEN 'SPEECH' ELSE 'NONSPEECH' END AS prediction, round(CASE WHEN n_speech > 0 THEN hi ELSE 1 - hi END, 6) AS confidence FROM g""")
def mt37_vad_decision(spark, d):
    return rounded(metrics.vad_decision(_frames(spark, d), "any"))


def _frames(spark, d):
    return role(spark, d, "waves").select("clip_id", F.explode("samples").alias("u")).select("clip_id", (F.abs(F.col("u").cast("double")) * 3).alias("prob"))


__all__ = ["paired_runs", "rounded"]


@query(f"""WITH v AS ({_VAD}), g AS (SELECT clip_id, count(*) AS n_frames, count(*) FILTER (prob >= 0.3) AS n_speech, avg(prob) AS a, min(prob) AS lo, max(prob) AS hi FROM v GROUP BY 1)
SELECT clip_id, n_frames, n_speech, round(a, 6) AS mean_prob, round(lo, 6) AS min_prob, round(hi, 6) AS max_prob, CASE WHEN a > 0.3 THEN 'SPEECH' ELSE 'NONSPEECH' END AS prediction, round(a, 6) AS confidence FROM g""")
def mt37_vad_decision_by_mean(spark, d):
    return rounded(metrics.vad_decision(_frames(spark, d), "mean", 0.3))


@query(f"""WITH v AS ({_VAD}), g AS (SELECT clip_id, count(*) AS n_frames, count(*) FILTER (prob >= 0.3) AS n_speech, avg(prob) AS a, min(prob) AS lo, max(prob) AS hi FROM v GROUP BY 1)
SELECT clip_id, n_frames, n_speech, round(a, 6) AS mean_prob, round(lo, 6) AS min_prob, round(hi, 6) AS max_prob, CASE WHEN n_speech / n_frames > 0.5 THEN 'SPEECH' ELSE 'NONSPEECH' END AS prediction, round(n_speech / n_frames, 6) AS confidence FROM g""")
def mt37_vad_decision_by_share(spark, d):
    return rounded(metrics.vad_decision(_frames(spark, d), "share", 0.3))
