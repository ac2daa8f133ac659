"""Ranking measures on distinct scores: WIN1-WIN6, WIN10, WIN11, AGG26, AGG36.

Everything starts by collapsing rows to one row per (curve, score), and ends in running totals over those.
``running_totals`` computes them with bounded tasks whatever the score distribution is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldaudit.operators.positions import with_position


def round_bits(x: Column, drop: int) -> Column:
    """A double rounded to 53 - ``drop`` significant bits (Veltkamp split); keeps order."""
    scaled = x * float(2**drop + 1)
    return scaled - (scaled - x)


def running_totals(df: DataFrame, score: str, values, keys) -> DataFrame:
    """Adds ``below_<v>``: total of v over the curve's rows with a smaller score. One row per (keys, score).

    Two coarser copies of the score (31 and 9 significant bits) nest around it. Every window partition
    is one cell of the next coarser copy, so it has at most 2^22 rows, for any data; the last window
    runs over the 9-bit cells of a curve, a few thousand at most in practice. No task sees a whole curve.
    """
    keys = list(keys)
    fine = df.withColumn("_m", round_bits(F.col(score), 22))
    fine = fine.withColumn("_t", round_bits(F.col("_m"), 44))
    mid = fine.groupBy(*keys, "_t", "_m").agg(*[F.sum(v).alias(v) for v in values])
    top = mid.groupBy(*keys, "_t").agg(*[F.sum(v).alias(v) for v in values])

    def before(part, order):
        return Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    def add(frame, part, order, prefix):
        w = before(part, order)
        return frame.withColumns({f"{prefix}{v}": F.coalesce(F.sum(v).over(w), F.lit(0)) for v in values})

    top = add(top, keys, "_t", "_a_").select(*keys, "_t", *[f"_a_{v}" for v in values])
    mid = add(mid, keys + ["_t"], "_m", "_b_").join(top, keys + ["_t"])
    mid = mid.select(*keys, "_t", "_m", *[(F.col(f"_a_{v}") + F.col(f"_b_{v}")).alias(f"_o_{v}") for v in values])
    fine = add(fine, keys + ["_t", "_m"], score, "_c_").join(mid, keys + ["_t", "_m"])
    out = fine.withColumns({f"below_{v}": F.col(f"_o_{v}") + F.col(f"_c_{v}") for v in values})
    return out.drop("_t", "_m", *[f"{p}{v}" for v in values for p in ("_o_", "_c_")])


def checked(df: DataFrame, label: str, score: str) -> DataFrame:
    """Stops on labels other than 0/1 and on missing or infinite scores, while rows flow by."""
    y, s = F.col(label), F.col(score).cast("double")
    bad_label = ~F.coalesce(y.isin(0, 1), F.lit(False))
    bad_score = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
    return df.withColumns({
        label: F.when(bad_label, F.raise_error(F.lit("labels must be 0 or 1")).cast("int")).otherwise(y.cast("int")),
        score: F.when(bad_score, F.raise_error(F.lit("scores must be finite")).cast("double")).otherwise(s),
    })


def score_counts(df: DataFrame, label: str, score: str, keys, weight: Column | None = None) -> DataFrame:
    """One row per (curve, score) with the weight of positives and negatives."""
    w = F.lit(1).cast("long") if weight is None else weight
    df = checked(df, label, score)
    return df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 0, w).otherwise(0)).alias("neg"))


def class_totals(counts: DataFrame, keys) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def auroc(counts: DataFrame, keys, strict: bool = True) -> DataFrame:
    """WIN1. Area under the ROC curve, ties counting one half. A curve with one class is an error."""
    run = running_totals(counts, "score", ["neg"], keys)
    out = run.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2)).alias("_u"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    value = F.when(both, F.col("_u") / (F.col("n_pos").cast("double") * F.col("n_neg")))
    if strict:
        value = F.when(~both, F.raise_error(F.lit("need both classes")).cast("double")).otherwise(value)
    return out.withColumn("auroc", value).drop("_u")


def curve(counts: DataFrame, keys) -> DataFrame:
    """Counts flagged at each threshold (score >= threshold), with class totals.

    The totals have one row per curve, so they are broadcast; a curve is a named system or subset.
    """
    run = running_totals(counts, "score", ["pos", "neg"], keys)
    out = run.join(F.broadcast(class_totals(counts, keys)), list(keys))
    return out.withColumns({"tp": F.col("n_pos") - F.col("below_pos"), "fp": F.col("n_neg") - F.col("below_neg")})


def average_precision(counts: DataFrame, keys) -> DataFrame:
    """WIN2. Step-wise area under the precision-recall curve, ties grouped."""
    c = curve(counts, keys)
    gain = F.col("pos") / F.col("n_pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return c.groupBy(*keys).agg(F.sum(gain).alias("pr_auc"))


def roc_points(counts: DataFrame, keys) -> DataFrame:
    """WIN3. One vertex per distinct score, in percent, plus the origin."""
    c = curve(counts, keys).select(
        *keys, "score", (100 * F.col("fp") / F.col("n_neg")).alias("fpr"), (100 * F.col("tp") / F.col("n_pos")).alias("tpr"))
    origin = class_totals(counts, keys).select(
        *keys, F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return c.unionByName(origin)


def thin_curve(points: DataFrame, keys, step: float = 0.5) -> DataFrame:
    """WIN4, re-aimed. One vertex per step-sized grid cell, and both ends of the curve."""
    vertex = F.struct("fpr", "tpr")
    cells = points.groupBy(*keys, F.floor(F.col("fpr") / step).alias("_x"), F.floor(F.col("tpr") / step).alias("_y"))
    inner = cells.agg(F.min(vertex).alias("v")).select(*keys, "v")
    ends = points.groupBy(*keys).agg(F.array(F.min(vertex), F.max(vertex)).alias("e"))
    return inner.unionByName(ends.select(*keys, F.explode("e").alias("v"))).distinct().select(*keys, "v.fpr", "v.tpr")


def operating_point(counts: DataFrame, keys, targets: DataFrame | float) -> DataFrame:
    """WIN5, WIN6. Threshold of the highest recall whose false-positive rate stays within the target.

    ``targets`` is one number, or a frame (keys, target) with one row per curve. The threshold lies
    halfway between the first score that would break the target and the next higher score.
    """
    keys = list(keys)
    c = curve(counts, keys)
    c = c.withColumn("target", F.lit(float(targets))) if isinstance(targets, (int, float)) else c.join(
        F.broadcast(targets), keys)
    allowed = F.floor(F.col("target") * F.col("n_neg"))
    c = c.withColumn("_all", allowed >= F.col("n_neg")).withColumn("_over", F.col("fp") > allowed)
    # Scores at or below the (k+1)-th highest negative have more than k negatives flagged.
    t = c.groupBy(*keys).agg(
        F.max(F.when(F.col("_over"), F.col("score"))).alias("_at"),
        F.min(F.when(~F.col("_over"), F.col("score"))).alias("_above"),
        F.min(F.when(F.col("neg") > 0, F.col("score"))).alias("_lowest"),
        F.max("_all").alias("_all"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"),
        F.max("target").alias("target"))
    next_up = F.col("_at") + F.abs(F.col("_at")) * float(2**-52)
    t = t.withColumn("threshold", F.when(F.col("_all"), F.col("_lowest")).otherwise(
        F.coalesce((F.col("_at") + F.col("_above")) / 2, next_up)))
    flagged = counts.join(F.broadcast(t.select(*keys, "threshold")), keys).where(F.col("score") >= F.col("threshold"))
    hits = flagged.groupBy(*keys).agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    out = t.join(hits, keys, "left").na.fill(0, ["tp", "fp"])
    return out.select(*keys, "target", "threshold", (F.col("fp") / F.col("n_neg")).alias("fpr"),
                      (F.col("tp") / F.col("n_pos")).alias("recall"), "n_pos", "n_neg")


def reliability(df: DataFrame, label: str, prob: str, keys, bins: int = 10) -> DataFrame:
    """AGG26. Count, mean confidence and observed rate per equal-width bin; empty bins stay as rows.

    A probability on an edge belongs to the upper bin, 1.0 to the last.
    """
    keys = list(keys)
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    index = F.lit(0)
    for e in edges:
        index = index + F.when(F.col(prob) >= e, 1).otherwise(0)
    seen = df.groupBy(*keys, index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(prob).alias("confidence"), F.avg(F.col(label).cast("double")).alias("observed"))
    scaffold = seen.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return scaffold.join(seen, keys + ["bin"], "left").na.fill(0, ["n"])


def calibration_error(table: DataFrame, keys) -> DataFrame:
    """AGG26. Expected calibration error from a reliability table."""
    gap = F.when(F.col("n") > 0, F.col("n") * F.abs(F.col("confidence") - F.col("observed"))).otherwise(0.0)
    return table.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def separability(near: DataFrame, far: DataFrame, value: str, keys) -> DataFrame:
    """WIN11. Chance that a value of ``far`` exceeds one of ``near``, ties one half."""
    both = near.select(*keys, F.col(value).cast("double").alias("v"), F.lit(0).alias("y"), "n").unionByName(
        far.select(*keys, F.col(value).cast("double").alias("v"), F.lit(1).alias("y"), "n"))
    return auroc(score_counts(both, "y", "v", keys, F.col("n").cast("long")), keys, strict=False)


def ordinal_ranks(df: DataFrame, score: str, id_col: str, keys, out: str) -> DataFrame:
    """WIN10. Ordinal rank by score; ties are not averaged but follow the hash order of their ids.

    That order lets one score shared by a third of all rows spread over many tasks.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    below = running_totals(counts, "score", ["n"], keys).select(*keys, F.col("score").alias("_s"), "below_n")
    tied = with_position(df.withColumn("_s", F.col(score).cast("double")), id_col, within=[*keys, "_s"], tag="tie", out="_tie")
    joined = tied.join(below, keys + ["_s"])
    return joined.withColumn(out, F.col("below_n") + F.col("_tie")).drop("_s", "_tie", "below_n")


def balanced_accuracy(df: DataFrame, label: str, prob: str, keys, cut: float = 0.5) -> DataFrame:
    """AGG36. Mean of the two class recalls."""
    hit = (F.col(prob) > cut).cast("int")
    r1 = F.avg(F.when(F.col(label) == 1, hit))
    r0 = F.avg(F.when(F.col(label) == 0, 1 - hit))
    return df.groupBy(*keys).agg(((r0 + r1) / 2).alias("balanced_accuracy"))
