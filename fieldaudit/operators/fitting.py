"""Fitted models: STA10, STA11, STA13, STA14. Fits return small parameter sets; scoring is column arithmetic."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldaudit.functions.measures import linear_score, log_loss, logit
from fieldaudit.sources.store import cut

# Search range of log temperature, and the range outside of which a fit is refused.
LOG_T_RANGE = (-4.0, 4.0)
T_LIMITS = (0.02, 50.0)


def loss_grid(df: DataFrame, z: str, y: str, log_ts, keys=()) -> DataFrame:
    """Mean negative log likelihood at each log temperature, all in one aggregate: (keys, i, log_t, nll)."""
    sums = df.groupBy(*keys).agg(*[
        F.avg(log_loss(F.col(z), F.col(y), math.exp(t))).alias(f"l{i}") for i, t in enumerate(log_ts)])
    return sums.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("log_t"), F.col(f"l{i}").alias("nll"))
        for i, t in enumerate(log_ts)])).alias("g")).select(*keys, "g.*")


def fit_temperature(df: DataFrame, z: str, y: str, points: int = 17, width: float = 1e-6) -> float:
    """STA10. Temperature of least loss. Every pass evaluates a grid in one aggregate and narrows around its best.

    Rows are first collapsed to distinct (logit, label) with counts, so later passes read less.
    """
    counts = cut(df.groupBy(F.col(z).alias("z"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n")))
    low, high = LOG_T_RANGE
    while high - low > width:
        step = (high - low) / (points - 1)
        grid = [low + i * step for i in range(points)]
        row = counts.agg(*[F.sum(log_loss(F.col("z"), F.col("y"), math.exp(t)) * F.col("n")) for t in grid]).first()
        best = min(range(points), key=lambda i: row[i])
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, points - 1)]
    t = math.exp((low + high) / 2)
    if not T_LIMITS[0] <= t <= T_LIMITS[1]:
        raise ValueError(f"temperature {t} hit the search bound")
    return t


def gram_sums(data: DataFrame, features, y: str, beta: list[float]) -> list[float]:
    """Loss, gradient and upper triangle of the Hessian of the log loss at ``beta`` (intercept first), from one aggregate."""
    x = [F.lit(1.0), *[F.col(f) for f in features]]
    z = sum((F.lit(b) * c for b, c in zip(beta[1:], x[1:])), F.lit(beta[0]))
    p, n = F.col("_p"), F.col("_n")
    # ln(1 + e^z) - y z, without an overflow.
    loss = F.greatest(F.col("_z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("_z"))) - F.col(y) * F.col("_z")
    sums = [n * loss, *[n * (p - F.col(y)) * c for c in x], *[n * p * (1 - p) * x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))]]
    rows = data.withColumn("_z", z).withColumn("_p", 1 / (1 + F.exp(-F.col("_z"))))
    return [float(v) for v in rows.agg(*[F.sum(s).alias(f"s{k}") for k, s in enumerate(sums)]).first()]


def fit_logistic(df: DataFrame, features, y: str, c: float = 1.0, tolerance: float = 1e-10, most_steps: int = 100) -> dict:
    """STA11. L2-penalised logistic regression, intercept free; penalty weight as in the sum-of-losses form.

    Newton steps on Gram sums: rows are collapsed to distinct ones with counts, and every step is one aggregate over them and a
    system of (features + 1) equations on the driver. A step that raises the loss is halved. Rows with a null are left out.
    """
    features = list(features)
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(y).cast("double").alias("_y")).dropna()
    data = cut(rows.groupBy(*features, "_y").agg(F.count(F.lit(1)).cast("double").alias("_n")))
    if data.agg(F.countDistinct("_y")).first()[0] != 2:
        raise ValueError("a fit needs both classes")
    k = len(features) + 1
    ridge = np.array([0.0] + [1.0] * (k - 1))
    beta, step, best = np.zeros(k), np.zeros(k), math.inf
    for _ in range(most_steps):
        sums = gram_sums(data, features, "_y", beta.tolist())
        loss = c * sums[0] + float(ridge @ beta**2) / 2
        if not loss <= best + 1e-12 * abs(best):
            step /= 2
            beta = beta - step
            continue
        hessian = np.zeros((k, k))
        hessian[np.triu_indices(k)] = sums[1 + k:]
        hessian = c * (hessian + np.triu(hessian, 1).T) + np.diag(ridge)
        best, step = loss, -np.linalg.solve(hessian, c * np.array(sums[1:1 + k]) + ridge * beta)
        beta = beta + step
        if np.abs(step).max() < tolerance:
            return {"features": features, "intercept": float(beta[0]), "coef": beta[1:].tolist(), "C": c}
    raise ValueError("no convergence: features that are not finite")


def fusion_features(score: Column, rule: Column, is_pan: Column) -> dict[str, Column]:
    """PRJ8. Clipped log odds of the detector, the rule flag, and the flag on PAN cards."""
    r = rule.cast("double")
    return {"z": logit(score), "r": r, "r_pan": r * is_pan.cast("double")}


def frozen_score(df: DataFrame, params: DataFrame, features) -> DataFrame:
    """STA13. Score from a one-row table of frozen parameters (intercept, coef array, fit_split), broadcast.

    Scoring rows of the split the parameters were fitted on is refused.
    """
    p = params.select("intercept", "coef", "fit_split", F.lit(1).alias("_one"))
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(p), "_one")
    same = F.raise_error(F.lit("parameters were fitted on this split")).cast("double")
    s = linear_score(F.col("intercept"), [(F.get("coef", F.lit(i)), F.col(f)) for i, f in enumerate(features)])
    return joined.withColumn("fused", F.when(F.col("split") == F.col("fit_split"), same).otherwise(s)).drop(
        "_one", "intercept", "coef", "fit_split")


def score_with(df: DataFrame, fitted: dict, out: str = "fused") -> DataFrame:
    """STA14. Score from a fitted parameter set."""
    return df.withColumn(out, linear_score(fitted["intercept"], [(w, F.col(f)) for w, f in zip(fitted["coef"], fitted["features"])]))
