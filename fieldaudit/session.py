"""Session settings shared by the entry point, the bench and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
}


def local_session(cores: str | int = "8", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Single-JVM session for tests and the bench. On a cluster use the session it provides."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("fieldaudit")
    builder = builder.config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
