"""Numeric column functions: FN13-FN18, PRJ8 inputs, STA13, STA17, AGG16."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963985  # fixed value: two-sided 95% normal quantile


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def sigmoid(z: Column, temperature=1.0) -> Column:
    """FN13."""
    return 1.0 / (1.0 + F.exp(-z / _c(temperature)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    """FN14. Log odds of a probability clipped to [eps, 1-eps]."""
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.log(q / (1 - q))


def log_loss(z: Column, y: Column, temperature=1.0, eps: float = 1e-12) -> Column:
    """FN15 per row: negative log likelihood of a temperature-scaled logit."""
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), sigmoid(z, temperature)))
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def ratio(num: Column, den: Column) -> Column:
    """AGG16's value: null, never 0, when the denominator is 0."""
    return F.when(den != 0, num.cast("double") / den)


def ratio_cell(num: Column, den: Column, why: str) -> Column:
    """AGG16. Value with its counts and the reason for a missing value."""
    return F.struct(
        ratio(num, den).alias("value"),
        num.cast("long").alias("num"),
        den.cast("long").alias("den"),
        F.when(den == 0, F.lit(why)).alias("undefined"),
    )


def _wilson_parts(k: Column, n: Column, z: float):
    p = k.cast("double") / n
    d = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return p, centre, half


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """FN17. Rate with a score interval clamped to [0, 1]; NaN when n is 0."""
    n = n.cast("double")
    p, centre, half = _wilson_parts(k, F.when(n > 0, n), z)
    nan = F.lit(float("nan"))
    return F.struct(
        F.coalesce(p, nan).alias("rate"),
        F.coalesce(F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), nan).alias("lo"),
        F.coalesce(F.when(n > 0, F.least(F.lit(1.0), centre + half)), nan).alias("hi"),
    )


def wilson_percent(k: Column, n: Column, z: float = Z95) -> Column:
    """FN17b. Interval in percent with one decimal, not clamped; null when n is 0."""
    n = F.when(n > 0, n.cast("double"))
    _, centre, half = _wilson_parts(k, n, z)
    return F.when(
        n > 0,
        F.struct(F.round(100 * (centre - half), 1).alias("lo"), F.round(100 * (centre + half), 1).alias("hi")),
    )


def coincidence(n: Column, issued, space) -> Column:
    """FN18. Chance that generated identifiers hit issued ones under uniform draws."""
    p = _c(issued).cast("double") / _c(space)
    return F.struct(
        p.alias("p_single"),
        (n * p).alias("expected"),
        (-F.expm1(n * F.log1p(-p))).alias("p_at_least_one"),
    )


def normal_half_width(p: Column, n: Column, z: float = Z95) -> Column:
    """STA17."""
    return z * F.sqrt(p * (1 - p) / F.greatest(F.lit(1), n))


def percent_text(x: Column, digits: int = 1) -> Column:
    """FN16: a rate as percent text, n/a when missing."""
    return F.when(x.isNull(), "n/a").otherwise(F.format_string(f"%.{digits}f", 100 * x))


def p_value_text(p: Column) -> Column:
    """FN16: a p value; 0 replicates on one side prints as an upper bound."""
    return (
        F.when(p == 0, "< 1e-4")
        .when(p < 0.01, F.format_string("%.4f", p))
        .otherwise(F.format_string("%.3f", p))
    )


def linear_score(intercept, terms) -> Column:
    """STA13. Sigmoid of an intercept plus weighted columns, from frozen parameters."""
    z = _c(intercept)
    for coef, column in terms:
        z = z + _c(coef) * column
    return sigmoid(z)
