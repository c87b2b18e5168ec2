"""Paired tests, rank correlation and resampled intervals. Rows are reduced to counts first; tails are taken on those."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import accuracy_table
from .ranking import cumulative, score_counts, score_parts


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-square by the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return scale * h


def t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t by the incomplete beta function."""
    x = df / (df + t * t)
    return _beta_share(df / 2, 0.5, x)


def _beta_share(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def mcnemar_counts(paired: DataFrame, a: str = "correct_a", b: str = "correct_b") -> DataFrame:
    """One row: n11, n10, n01, n00 of correctness of two runs."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    x, y = F.col(a), F.col(b)
    return paired.agg(count(x & y)("n11"), count(x & ~y)("n10"), count(~x & y)("n01"), count(~x & ~y)("n00"))


def mcnemar(paired: DataFrame, correction: bool = True, a: str = "correct_a", b: str = "correct_b") -> DataFrame:
    """One row: the counts, chi2, p_value, effect and cohen_g; 0 and 1 without discordant pairs.

    n10 counts rows that a has right and b wrong, n01 the reverse; effects are positive where a is the better one. The
    correction takes one from the counts' difference, also where there is none, before it is squared.
    """

    def test(batches):
        for rows in batches:
            out = rows.copy()
            d = (rows.n10 + rows.n01).astype(float)
            gap = (rows.n10 - rows.n01).astype(float)
            some = d.where(d > 0, 1)
            out["chi2"] = np.where(d > 0, (gap.abs() - (1.0 if correction else 0.0)) ** 2 / some, 0.0)
            out["p_value"] = [math.erfc(math.sqrt(c / 2)) if n > 0 else 1.0 for c, n in zip(out["chi2"], d)]
            out["effect"], out["cohen_g"] = gap / some, gap / np.sqrt(some)
            yield out

    return mcnemar_counts(paired, a, b).mapInPandas(test, "n11 long, n10 long, n01 long, n00 long, chi2 double, p_value double, effect double, cohen_g double")


def bootstrap_accuracy(df: DataFrame, by: list[str], n: int = 10_000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """by, mean, std (population), low, high, width of the resampled accuracy in %.

    Resampling n rows of which k are right gives a Binomial(n, k / n) count, drawn on the counts.
    """
    cells = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("long")).alias("k"))

    def draw(batches):
        for rows in batches:
            out = rows.copy()
            stats = []
            for size, right in zip(rows["n"], rows["k"]):
                got = 100.0 * np.random.default_rng([seed, int(size), int(right)]).binomial(size, right / size, n) / size
                low, high = np.percentile(got, [50 * (1 - level), 50 * (1 + level)])
                stats.append((got.mean(), got.std(), low, high, high - low))
            for i, name in enumerate(("mean", "std", "low", "high", "width")):
                out[name] = [s[i] for s in stats]
            yield out

    kinds = dict(df.dtypes)
    return cells.mapInPandas(draw, ", ".join([f"{c} {kinds[c]}" for c in by] + ["n long", "k long"] + [f"{c} double" for c in ("mean", "std", "low", "high", "width")]))


def bootstrap_mean(values: DataFrame, value: str, n: int = 10_000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """One row: n, mean, low, high of the mean over a table of runs or seeds (few rows)."""
    gathered = values.agg(F.array_sort(F.collect_list(value)).alias("v"))

    def draw(batches):
        import pandas as pd

        for rows in batches:
            for v in rows["v"]:
                v = np.asarray(v, float)
                got = np.random.default_rng(seed).choice(v, (n, len(v))).mean(axis=1) if len(v) else np.array([np.nan])
                low, high = np.percentile(got, [50 * (1 - level), 50 * (1 + level)])
                yield pd.DataFrame([{"n": len(v), "mean": v.mean() if len(v) else np.nan, "low": low, "high": high}])

    return gathered.mapInPandas(draw, "n long, mean double, low double, high double")


def compare_models(paired: DataFrame, names: tuple[str, str] = ("a", "b"), n: int = 10_000) -> DataFrame:
    """A row for each model: accuracies and interval; and the paired test, the first's accuracy less the second's and whether the intervals overlap."""
    long = None
    for name in names:
        part = paired.select(F.lit(name).alias("model"), F.col(f"ground_truth_{name}").alias("ground_truth"), F.col(f"correct_{name}").alias("correct"))
        long = part if long is None else long.unionByName(part)
    table = accuracy_table(long, ["model"]).join(bootstrap_accuracy(long, ["model"], n).select("model", "low", "high"), "model")
    test = mcnemar(paired, a=f"correct_{names[0]}", b=f"correct_{names[1]}").select("chi2", "p_value", "effect")
    both = Window.partitionBy(F.lit(0))
    table = table.withColumn("difference", F.max(F.when(F.col("model") == names[0], F.col("accuracy"))).over(both) - F.max(F.when(F.col("model") == names[1], F.col("accuracy"))).over(both))
    table = table.withColumn("overlap", F.max("low").over(both) <= F.min("high").over(both))
    return table.join(F.broadcast(test))  # one row


def chi2_independence(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2, dof, p_value of the cross table of two columns, with Yates' correction when it is 2 x 2."""
    cells = df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("o"))
    whole = Window.partitionBy(F.lit(0))
    total, n_a, n_b = F.sum("o").over(whole), F.sum("o").over(Window.partitionBy(a)), F.sum("o").over(Window.partitionBy(b))
    rows = cells.withColumn("e", n_a * n_b / total).withColumn("n", total)
    size = rows.agg(F.countDistinct(a).alias("ra"), F.countDistinct(b).alias("rb"))
    rows = rows.join(F.broadcast(size))
    gap = F.abs(F.col("o") - F.col("e"))
    yates = (F.col("ra") == 2) & (F.col("rb") == 2)
    gap = F.when(yates, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    # Cells without rows add their expectation: all expectations sum to n.
    absent = F.max("n") - F.sum("e")
    stat = rows.agg((F.sum(gap * gap / F.col("e")) + absent).alias("chi2"), ((F.max("ra") - 1) * (F.max("rb") - 1)).cast("int").alias("dof"))

    def tail(batches):
        for r in batches:
            yield r.assign(p_value=[chi2_tail(c, int(d)) if d > 0 else 1.0 for c, d in zip(r["chi2"], r["dof"])])

    return stat.mapInPandas(tail, "chi2 double, dof int, p_value double")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, rho, p_value, with average ranks for ties, from counts of value pairs."""
    pairs = df.dropna(subset=[x, y]).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("w"))
    ranked = pairs
    for c in ("x", "y"):
        values = cumulative(pairs.groupBy(F.col(c).alias("score")).agg(F.sum("w").alias("p"), F.lit(0).cast("long").alias("q")), [])
        # Of ``all_p`` rows, tp have this value or a greater one.
        rank = F.col("all_p") - F.col("tp") + (F.col("p") + 1) / 2.0
        ranked = ranked.join(values.select(F.col("score").alias(c), rank.alias(f"r{c}")), c)
    w, a, b = F.col("w"), F.col("rx"), F.col("ry")
    s = ranked.agg(F.sum("w").alias("n"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"), F.sum(w * a * b).alias("ab"))
    n = F.col("n")
    rho = F.try_divide(n * F.col("ab") - F.col("a") * F.col("b"), F.sqrt(n * F.col("aa") - F.col("a") * F.col("a")) * F.sqrt(n * F.col("bb") - F.col("b") * F.col("b")))
    stat = s.select("n", rho.alias("rho"))

    def tail(batches):
        for r in batches:
            p = [t_tail(v * math.sqrt((m - 2) / max(1e-300, 1 - v * v)), m - 2) if m > 2 and v == v else float("nan") for v, m in zip(r["rho"], r["n"])]
            yield r.assign(p_value=p)

    return stat.mapInPandas(tail, "n long, rho double, p_value double")


def bootstrap_auc(df: DataFrame, n: int = 1000, level: float = 0.95, seed: int = 0, score: str = "score", bins: int | None = None, parts: int = 64) -> DataFrame:
    """metric (auc, ap), low, median, high, n_valid over resamples; resamples of one class are left out.

    Rows become class counts at distinct scores, or, only if ``bins`` is given, at that many equal steps of the score. Each
    replicate draws a multinomial over those counts in two stages: over ``parts`` ranges of scores, alike in every task, and
    within a range in the task that holds it.
    """
    cells = score_counts(df, [], score)
    if bins:
        low, high = cells.agg(F.min("score"), F.max("score")).first()
        step = F.floor((F.col("score") - low) / ((high - low) or 1.0) * bins) if low is not None else F.lit(0)
        cells = cells.groupBy(step.cast("double").alias("score")).agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    cells = score_parts(cells, [], parts)
    sums = {r["_part"]: (r["p"], r["q"]) for r in cells.groupBy("_part").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).collect()}  # ``parts`` rows
    order = sorted(sums, reverse=True)  # from the highest scores on
    share = np.array([sums[k] for k in order], float).reshape(-1, 2)
    total = int(share.sum())

    def draw(rows):
        import pandas as pd

        rows = rows.sort_values("score", ascending=False)
        at = order.index(int(rows["_part"].iloc[0]))
        p, q = rows["p"].to_numpy(), rows["q"].to_numpy()
        out = []
        for replicate in range(n):
            drawn = np.random.default_rng([seed, replicate]).multinomial(total, (share / total).ravel()).reshape(-1, 2)
            (all_p, all_q), (before_p, before_q) = drawn.sum(axis=0), drawn[:at].sum(axis=0)
            if not all_p or not all_q:
                continue
            rng = np.random.default_rng([seed, replicate, at])
            rp, rq = (rng.multinomial(k, c / c.sum()) if k else np.zeros(len(c), np.int64) for k, c in zip(drawn[at], (p, q)))
            tp, fp = before_p + rp.cumsum(), before_q + rq.cumsum()
            seen = tp + fp > 0
            out.append((replicate, float((rp * (all_q - fp + rq / 2)).sum() / (all_p * all_q)), float((rp[seen] / all_p * tp[seen] / (tp + fp)[seen]).sum())))
        return pd.DataFrame(out, columns=["replicate", "auc", "ap"])

    drawn = cells.groupBy("_part").applyInPandas(draw, "replicate int, auc double, ap double").groupBy("replicate").agg(F.sum("auc").alias("auc"), F.sum("ap").alias("ap"))
    long = drawn.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("auc", "ap")])).alias("r")).select("r.*")
    tail = (1 - level) / 2
    return long.groupBy("metric").agg(F.count(F.lit(1)).alias("n_valid"), F.percentile("v", tail).alias("low"), F.percentile("v", 0.5).alias("median"), F.percentile("v", 1 - tail).alias("high"))
