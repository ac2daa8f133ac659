from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldaudit.llm.common import table
from fieldaudit.llm.pii import BASE_KINDS, joined, personal_data


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: the base spans, and all spans."""
    df = personal_data(table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{BASE_KINDS[k]}")
    return df.select(F.col("key").alias("doc_id"), *map(number, range(len(BASE_KINDS))), F.sha2(joined(F.array_sort("base")), 256).alias("base_sha256"),
                     joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))


QUERIES = {"op6_pii": op6_pii}
