"""SNK1-SNK10. All sinks write folders of part files, in parallel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldaudit.sources.schema import FLAT_COLUMNS


def json_lines(df: DataFrame, path: str) -> None:
    """SNK1. Nested rows as JSON lines; missing fields are written as null."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def flat_manifest(df: DataFrame, path: str) -> None:
    """SNK2. The 24 flat columns as CSV; other columns are left out, absent ones are empty."""
    cols = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in FLAT_COLUMNS]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def predictions(df: DataFrame, path: str) -> None:
    """SNK3. image_id, decision and, where present, the score with six decimals."""
    cols = [F.col("image_id"), F.col("decision").cast("int").alias("decision")]
    if "score" in df.columns:
        cols.append(F.format_string("%.6f", F.col("score")).alias("score"))
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def report_json(df: DataFrame, path: str) -> None:
    """SNK4. Metric rows as JSON text."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def report_rows(df: DataFrame, section: str, cell_columns, n: str, metrics, interval: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """SNK5. A metric frame as tidy rows (section, cell, metric, value, lo, hi, n)."""
    none = F.lit(None).cast("double")
    spans = interval or {}
    rows = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"),
                 *[(F.col(spans[m][i]).cast("double") if m in spans else none).alias(name) for i, name in enumerate(("lo", "hi"))])
        for m in metrics]))
    return df.select(F.lit(section).alias("section"), F.concat_ws("/", *cell_columns).alias("cell"), rows.alias("r"),
                     F.col(n).cast("long").alias("n")).select("section", "cell", "r.metric", "r.value", "r.lo", "r.hi", "n")


def report(parts, path: str) -> None:
    """SNK5. Several metric frames as one stored report."""
    reduce(DataFrame.unionByName, parts).write.mode("overwrite").parquet(path)


def with_added_column(df: DataFrame, name: str, column, path: str) -> None:
    """SNK6. The table with one more column, at a new path."""
    df.withColumn(name, column).write.mode("errorifexists").parquet(path)


def candidate_pairs(pairs: DataFrame, path: str) -> None:
    """SNK7. Pairs in order of distance; the sort is a range exchange, so parts are written in parallel."""
    pairs.orderBy("distance", "id_a", "id_b").write.mode("overwrite").option("header", True).csv(path)


def rule_decisions(df: DataFrame, path: str) -> None:
    """SNK8."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def ensemble_and_reliability(ensemble: DataFrame, reliability: DataFrame, path: str) -> None:
    """SNK9."""
    ensemble.withColumn("prob", F.format_string("%.6f", "prob")).write.mode("overwrite").option("header", True).csv(f"{path}/ensemble")
    reliability.write.mode("overwrite").option("header", True).csv(f"{path}/reliability")


def fingerprint_manifest(rows: DataFrame, digest: DataFrame, path: str) -> None:
    """SNK10. Per-row fingerprints and the aggregate digest row."""
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/manifest")
    digest.write.mode("overwrite").option("header", True).csv(f"{path}/digest")
