"""Accuracy over duration or SNR: curves, crossing points, resampled points and fitted curves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a task where groups are about as many as rows.
ROWS = 250_000


def accuracy_curve(df: DataFrame, x: str, by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """by, x, n, n_correct, accuracy_pct at each known x. ``parts``: for groups about as many as rows, so many tasks count them; else Spark's own number, after a count before the shuffle."""
    by, rows = by or [], df.filter(F.col(x).isNotNull())
    rows = rows.select(*by, F.col(x).alias("x"), F.col("correct").cast("long").alias("_c"))
    rows = rows.repartition(parts, *by, "x") if parts else rows
    out = rows.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("n"), F.sum("_c").alias("n_correct"))
    return out.withColumn("accuracy_pct", 100.0 * F.col("n_correct") / F.col("n"))


def curve_threshold(curve: DataFrame, target: float, by: list[str] | None = None) -> DataFrame:
    """by, threshold: x at which accuracy crosses ``target``, linear between points sorted by accuracy; null unless min < target < max."""
    return curve_thresholds(curve, [target], by).drop("target")


def curve_thresholds(curve: DataFrame, targets: list[float], by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """by, target, threshold for all targets at once; ``parts``: so many tasks, for many curves."""
    by = by or []
    order = Window.partitionBy(*by, F.lit(0)).orderBy("accuracy_pct", "x")
    rows = curve.repartition(parts, *by) if parts and by else curve
    rows = rows.withColumn("_y", F.lead("accuracy_pct").over(order)).withColumn("_x", F.lead("x").over(order))

    def at(target):
        part = F.try_divide(F.lit(target) - F.col("accuracy_pct"), F.col("_y") - F.col("accuracy_pct"))
        return F.when((F.col("accuracy_pct") <= target) & (F.col("_y") > target), F.col("x") + part * (F.col("_x") - F.col("x")))

    crossed = [F.min_by(at(t), F.when(at(t).isNotNull(), F.col("accuracy_pct"))).alias(f"_at{i}") for i, t in enumerate(targets)]
    out = rows.groupBy(*by).agg(*crossed, F.min("accuracy_pct").alias("_low"), F.max("accuracy_pct").alias("_high"))
    found = [F.struct(F.lit(float(t)).alias("target"), F.when((F.col("_low") < t) & (F.col("_high") > t), F.col(f"_at{i}")).alias("threshold")) for i, t in enumerate(targets)]
    return out.select(*by, F.inline(F.array(*found)))


def thresholds_of_many(df: DataFrame, x: str, targets: list[float], by: list[str], rows: int = ROWS) -> DataFrame:
    """by, target, threshold of many small curves, as of clips: tasks hold ``rows`` rows each, however many there are."""
    parts = max(1, -(-df.count() // rows))
    return curve_thresholds(accuracy_curve(df, x, by, parts), targets, by, parts)


def crossing(x: np.ndarray, y: np.ndarray, target: float) -> float:
    """The same for arrays; NaN where there is no crossing."""
    order = np.lexsort((x, y))
    x, y = x[order], y[order]
    return float(np.interp(target, y, x)) if y[0] < target < y[-1] else float("nan")


def bootstrap_curve_threshold(df: DataFrame, x: str, target: float, n: int = 1000, seed: int = 0, parts: int = 64) -> DataFrame:
    """n_valid, median, low, high of the crossing over ``n`` resamples.

    Resampling rows with replacement is a multinomial draw over the (x, correct) cells: over ``parts`` hashed parts of the points once,
    then over the cells of a part in the task that holds it. Of a part and a replicate only the points next to
    the target go on, the highest at or below it and the lowest above, and the crossing lies between the best of all parts. So x may take any number of values.
    """
    cells = accuracy_curve(df, x).select(F.col("x").cast("double").alias("x"), "n", "n_correct").withColumn("_part", F.pmod(F.xxhash64("x"), F.lit(parts)).cast("int"))
    sums = {r["_part"]: r["n"] for r in cells.groupBy("_part").agg(F.sum("n").alias("n")).collect()}  # ``parts`` rows
    order, total = sorted(sums), sum(sums.values())
    drawn = np.random.default_rng([seed, 0]).multinomial(total, np.array([sums[k] for k in order]) / max(total, 1), size=n).astype(np.int64) if order else np.zeros((n, 0), np.int64)

    def draw(rows):
        import pandas as pd

        part = int(rows["_part"].iloc[0])
        rows = rows.sort_values("x")
        xs, size, right = rows["x"].to_numpy(float), rows["n"].to_numpy(), rows["n_correct"].to_numpy()
        rng, share, out = np.random.default_rng([seed, 1, part]), np.concatenate([right, size - right]) / size.sum(), []
        step = max(1, (1 << 21) // (2 * len(xs)))
        for at in range(0, n, step):
            got = rng.multinomial(drawn[at : at + step, order.index(part)], share).reshape(-1, 2, len(xs))
            for i, (hits, all_) in enumerate(zip(got[:, 0], got.sum(axis=1))):
                some = all_ > 0
                if some.any():
                    y, px = 100.0 * hits[some] / all_[some], xs[some]
                    rank = np.lexsort((px, y))
                    y, px = y[rank], px[rank]
                    below = int(np.searchsorted(y, target, "right"))
                    under = (y[below - 1], px[below - 1]) if below else (None, None)
                    over = (y[below], px[below]) if below < len(y) else (None, None)
                    out.append((at + i, *under, *over, y[0], y[-1]))
        return pd.DataFrame(out, columns=["replicate", "y0", "x0", "y1", "x1", "low", "high"])

    ends = cells.groupBy("_part").applyInPandas(draw, "replicate int, y0 double, x0 double, y1 double, x1 double, low double, high double")
    pair = lambda y, v: F.when(F.col(y).isNotNull(), F.struct(F.col(y).alias("y"), F.col(v).alias("x")))
    best = ends.groupBy("replicate").agg(F.max(pair("y0", "x0")).alias("a"), F.min(pair("y1", "x1")).alias("b"), F.min("low").alias("low"), F.max("high").alias("high"))
    at = F.col("a.x") + (F.lit(target) - F.col("a.y")) / (F.col("b.y") - F.col("a.y")) * (F.col("b.x") - F.col("a.x"))
    found = best.filter((F.col("low") < target) & (F.col("high") > target)).select(at.alias("threshold"))
    q = lambda p, name: F.percentile("threshold", p).alias(name)  # noqa: E731  ``n`` values
    return found.agg(F.count(F.lit(1)).alias("n_valid"), q(0.5, "median"), q(0.025, "low"), q(0.975, "high"))


# ---------------------------------------------------------------------------- fitted curves


def curve_value(x: np.ndarray, slope: float, x50: float, lapse: float, gamma: float) -> np.ndarray:
    return gamma + (1 - gamma - lapse) / (1 + np.exp(-np.clip(slope * (x - x50), -60, 60)))


def _batch(theta: np.ndarray, x: np.ndarray, n: np.ndarray, k: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(negative log-likelihood, score, information) of log slope, x50 and lapse, a row of ``theta`` for each row of cells."""
    slope, off = np.exp(theta[:, :1]), x - theta[:, 1:2]
    g = 1 / (1 + np.exp(-np.clip(slope * off, -60, 60)))
    height = 1 - gamma - theta[:, 2:3]
    p = np.clip(gamma + height * g, 1e-9, 1 - 1e-9)
    loss = -(k * np.log(p) + (n - k) * np.log(1 - p)).sum(axis=1)
    bend = height * g * (1 - g) * slope
    change = np.stack([bend * off, -bend, -g], axis=2)  # of p, by each parameter
    weight = 1 / (p * (1 - p))
    score = np.einsum("sm,smi->si", (k - n * p) * weight, change)
    return loss, score, np.einsum("sm,smi,smj->sij", n * weight, change, change)


def fit_batch(x: np.ndarray, n: np.ndarray, k: np.ndarray, gamma: float = 0.5, starts: int = 8, rounds: int = 80) -> dict[str, np.ndarray]:
    """Maximum likelihood of slope, x50 and lapse (0 to 0.1) for rows of cells, all at once; cells with n = 0 do not count.

    Fisher scoring from the best ``starts`` of a coarse grid: a step is the information's inverse times the score, halved until the likelihood
    does not fall; a lapse or another parameter at its bound that the score pushes outwards stays there. Standard errors are the
    inverse information's, of the parameters inside their bounds, and, by the slope of the crossing in them, dt75's.
    """
    cases, used = len(x), n > 0
    low, high = np.where(used, x, np.inf).min(axis=1), np.where(used, x, -np.inf).max(axis=1)
    span = np.maximum(high - low, 1e-9)
    grid = np.array([(s, c, v) for s in np.log(np.geomspace(0.5, 200, 16)) for c in np.linspace(-0.5, 1, 16) for v in (0.0, 0.03, 0.1)])
    theta = np.stack([grid[:, 0] - np.log(span)[:, None], low[:, None] + grid[:, 1] * span[:, None], np.broadcast_to(grid[:, 2], (cases, len(grid)))], axis=2)
    losses = np.stack([_batch(theta[:, i], x, n, k, gamma)[0] for i in range(len(grid))], axis=1)
    best = np.argsort(losses, axis=1, kind="stable")[:, :starts]
    theta = np.take_along_axis(theta, best[:, :, None], axis=1).reshape(-1, 3)
    cells = [np.repeat(v, starts, axis=0) for v in (x, n, k)]
    bounds = [np.repeat(np.stack(v, axis=1), starts, axis=0) for v in ((np.log(0.01 / span), low - 5 * span, np.zeros(cases)), (np.log(2000 / span), high + 5 * span, np.full(cases, 0.1)))]

    def free(theta, score):
        return ~(((theta <= bounds[0]) & (score < 0)) | ((theta >= bounds[1]) & (score > 0)))

    loss, score, info = _batch(theta, *cells, gamma)
    for _ in range(rounds):
        inside = free(theta, score)
        m = np.where(inside[:, :, None] & inside[:, None, :], info, 0.0)
        m[:, range(3), range(3)] += np.where(inside, 1e-9 * (1 + np.diagonal(info, axis1=1, axis2=2)), 1.0)
        step = np.linalg.solve(m, np.where(inside, score, 0.0)[:, :, None])[:, :, 0]
        scale, moved = np.ones((len(theta), 1)), np.zeros(len(theta), bool)
        for _ in range(25):
            tried = np.clip(theta + scale * step, *bounds)
            after = _batch(tried, *cells, gamma)[0]
            good = ~moved & (after < loss - 1e-12)
            theta, loss, moved = np.where(good[:, None], tried, theta), np.where(good, after, loss), moved | good
            scale = np.where(moved[:, None], scale, scale / 2)
            if moved.all():
                break
        if not moved.any():
            break
        loss, score, info = _batch(theta, *cells, gamma)
    pick = np.argmin(loss.reshape(cases, starts), axis=1) + np.arange(cases) * starts
    theta, loss, score, info = theta[pick], loss[pick], score[pick], info[pick]
    inside = (theta > np.stack([b[pick] for b in bounds])[0]) & (theta < np.stack([b[pick] for b in bounds])[1])
    m = np.where(inside[:, :, None] & inside[:, None, :], info, 0.0)
    m[:, range(3), range(3)] += np.where(inside, 0.0, 1.0)
    cov = np.where(inside[:, :, None] & inside[:, None, :], np.linalg.pinv(m, rcond=1e-12, hermitian=True), 0.0)
    slope, x50, lapse = np.exp(theta[:, 0]), theta[:, 1], theta[:, 2]
    sd = lambda v: np.sqrt(np.maximum(v, 0.0))
    error = lambda i, unit=1.0: np.where(inside[:, i], sd(cov[:, i, i]) * unit, np.nan)
    ratio = (1 - lapse - gamma) / 0.25 - 1  # what the logistic has to reach for 75 %
    there = (gamma < 0.75) & (ratio > 0)
    logs = np.log(np.where(there, ratio, 1.0))
    dt75 = np.where(there, x50 - logs / slope, np.nan)
    tilt = np.stack([logs / slope, np.ones(cases), 1 / (0.25 * np.where(there, ratio, 1.0) * slope)], axis=1)  # of dt75, by each parameter
    p = np.clip(gamma + (1 - gamma - lapse)[:, None] / (1 + np.exp(-np.clip(slope[:, None] * (x - x50[:, None]), -60, 60))), 1e-9, 1 - 1e-9)
    trials, hits = n.sum(axis=1), k.sum(axis=1)
    share = hits / np.maximum(trials, 1)
    null = -(hits * np.log(np.maximum(share, 1e-12)) + (trials - hits) * np.log(np.maximum(1 - share, 1e-12)))
    tjur = (p * k).sum(axis=1) / np.maximum(hits, 1) - (p * (n - k)).sum(axis=1) / np.maximum(trials - hits, 1)
    return {
        "slope": slope, "x50": x50, "lapse": lapse, "slope_se": error(0, slope), "x50_se": error(1), "lapse_se": error(2), "dt50": x50, "dt75": dt75,
        "dt75_se": np.where(there & inside.any(axis=1), sd(np.einsum("si,sij,sj->s", tilt, cov, tilt)), np.nan), "loss": loss, "mcfadden": np.where(null > 0, 1 - loss / np.where(null > 0, null, 1.0), 0.0), "tjur": tjur, "n": trials.astype(np.int64),
    }


def fit_cells(x: np.ndarray, n: np.ndarray, k: np.ndarray, gamma: float = 0.5) -> dict:
    """The same for one stratum."""
    return {name: v[0].item() for name, v in fit_batch(*(np.asarray(v, float)[None, :] for v in (x, n, k)), gamma).items()}


FITTED = ("slope", "x50", "lapse", "slope_se", "x50_se", "lapse_se", "dt50", "dt75", "dt75_se", "mcfadden", "tjur")


def fit_psychometric(df: DataFrame, x: str, by: list[str], gamma: float = 0.5) -> DataFrame:
    """by, the fitted curve of each stratum (FITTED) and n, from its (x, n, n_correct) cells; null where a value does not exist.

    dt50 is where the curve is half way between chance and its top, dt75 where it is right in 75 %. A stratum's different x are few; the
    strata of a batch are fitted together.
    """
    cells = accuracy_curve(df, x, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), "n", "n_correct"))).alias("_c"))
    kinds = dict(df.dtypes)

    def fit(batches):
        import pandas as pd

        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.iloc[at : at + 128]
                width = max(map(len, part["_c"]))
                table = np.zeros((3, len(part), width))
                for i, points in enumerate(part["_c"]):
                    table[:, i, : len(points)] = np.array([(c["x"], c["n"], c["n_correct"]) for c in points]).T
                    table[0, i, len(points) :] = points[0]["x"]
                found = fit_batch(*table, gamma)
                out = part[by].reset_index(drop=True)
                for c in FITTED:
                    out[c] = pd.Series(found[c]).replace([np.inf, -np.inf], np.nan)
                yield out.assign(n=found["n"])

    schema = ", ".join([f"{c} {kinds[c]}" for c in by] + [f"{c} double" for c in FITTED] + ["n long"])
    rows = cells.mapInPandas(fit, schema)
    return rows.select(*by, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in FITTED], "n")
