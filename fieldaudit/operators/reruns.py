"""A run against its repetition: AUD6 with SET6, STA16, JOI16, JOI17, and the score-run check's digest (AUD5).

Settings of a run are one JSON text of any shape. They become rows of (path, value) in rounds: every round opens the objects and
arrays that are left by one level, so a run's settings are compared by an outer join of rows and not inside one value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldaudit.operators.audits import with_overall
from fieldaudit.operators.ranking import ordinal_ranks
from fieldaudit.sources.store import cut


def _is_container(value: Column) -> Column:
    """Objects and arrays with something inside; empty ones are values."""
    kind = F.schema_of_variant(value)
    return (kind.startswith("OBJECT<") | kind.startswith("ARRAY<")) & ~F.to_json(value).isin("{}", "[]")


def flattened(df: DataFrame, keys, settings: str) -> DataFrame:
    """(keys, path, value) for every value in a JSON text: ``$.a.b[0]``, odd names quoted (``$."k.z"``), values as JSON.

    A null or broken text has no rows; an empty object or array is a value.
    """
    keys = list(keys)
    todo = cut(df.select(*keys, F.lit("$").alias("path"), F.try_parse_json(settings).alias("v")).where(F.col("v").isNotNull()))
    done = []
    while not todo.isEmpty():
        done.append(todo.where(~_is_container(F.col("v"))).select(*keys, "path", F.to_json("v").alias("value")))
        inside = todo.where(_is_container(F.col("v"))).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()))
        quoted = F.regexp_replace("key", r'(["\\])', r"\\$1")
        name = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(
            F.col("key").rlike(r"\A[A-Za-z0-9_]+\z"), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit('."'), quoted, F.lit('"')))
        todo = cut(inside.select(*keys, F.concat("path", name).alias("path"), F.col("value").alias("v")))
    return reduce(DataFrame.unionByName, done) if done else todo.select(*keys, "path", F.lit(None).cast("string").alias("value"))


def settings_differences(first: DataFrame, second: DataFrame, settings: str, ignored=()) -> DataFrame:
    """SET6. (path, first, second) where the settings of two runs differ; one side is null where the path is not there.

    ``ignored`` names paths; what lies below them is ignored too.
    """
    a = flattened(first, [], settings).withColumnRenamed("value", "first")
    b = flattened(second, [], settings).withColumnRenamed("value", "second")
    out = a.join(b, "path", "full_outer").where(~F.col("first").eqNullSafe(F.col("second")))
    for path in ignored:
        below = F.substring("path", 1, len(path) + 1).isin(path + ".", path + "[")
        out = out.where((F.col("path") != path) & ~below)
    return out


def agreement(a: DataFrame, b: DataFrame, key: str, score: str) -> DataFrame:
    """JOI16, STA16. Pearson and Spearman (ordinal ranks) correlation, largest difference, and how many scores are the same."""
    j = a.select(key, F.col(score).cast("double").alias("x")).join(b.select(key, F.col(score).cast("double").alias("y")), key)
    j = j.withColumn("curve", F.lit("all"))
    ranked = ordinal_ranks(ordinal_ranks(j, "x", key, ["curve"], "rx"), "y", key, ["curve"], "ry")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"),
                      F.max(F.abs(F.col("x") - F.col("y"))).alias("max_abs_diff"),
                      F.sum((F.col("x") == F.col("y")).cast("int")).alias("identical"))


def inside_ranges(seeds: DataFrame, rerun: DataFrame) -> DataFrame:
    """STA16. (metric, value, low, high, inside): metrics of a re-run against the range over the seeds; both are (metric, value)."""
    span = seeds.groupBy("metric").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return rerun.join(span, "metric", "left").select(
        "metric", "value", "low", "high", F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(False)).alias("inside"))


def recomputed(stored: DataFrame, again: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """(metric, off): stored metrics that are farther than the tolerance from those recomputed, or that were not recomputed."""
    j = stored.join(again.withColumnRenamed("value", "again"), "metric", "full_outer")
    return j.select("metric", (~F.coalesce(F.abs(F.col("value") - F.col("again")) < tolerance, F.lit(False))).alias("off"))


def rerun_checks(settings: DataFrame, digests: DataFrame, ranges: DataFrame, recomputed_metrics: DataFrame) -> DataFrame:
    """AUD6. The named checks of a re-run, and their total ``all``.

    ``settings``: what differs, without the ignored paths; ``digests``: (digest) of the edit regions, one row a run; ``ranges`` and
    ``recomputed_metrics`` as above. One check per metric in the ranges.
    """
    row = lambda df, name, passed: df.agg(passed.alias("passed")).select(F.lit(name).alias("check"), "passed")
    checks = reduce(DataFrame.unionByName, [
        row(settings, "settings identical", F.count("*") == 0),
        row(digests, "regions identical", (F.countDistinct("digest") == 1) & (F.count("digest") == 2)),
        ranges.select(F.concat("metric", F.lit(" in the range of the seeds")).alias("check"), F.col("inside").alias("passed")),
        row(recomputed_metrics, "stored metrics recomputed", F.coalesce(~F.bool_or("off"), F.lit(False)))])
    return with_overall(checks, F.bool_and("passed").alias("passed"))
