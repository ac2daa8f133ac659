"""Derived tables made once per application, then scanned like any stored table.

Where the cluster names a shared folder in spark.checkpoint.dir, the table is written there: that cuts lineage for good, and
later queries push filters and column lists into its scan. Without one it is persisted with its lineage, so that lost parts are
computed again; nothing is ever written to a folder of one machine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_made: dict[tuple[str, str, str], str | None] = {}


def shared_root(spark: SparkSession) -> str | None:
    """The folder that the cluster names in spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else None


def side_session(spark: SparkSession) -> SparkSession:
    """A session with settings of its own for wide derivations: past what one generated method holds, whole-stage code is slower
    to make and to run than one projection after another. The caller's settings stay as they are."""
    side = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        side.conf.set(name, spark.conf.get(name))
    side.conf.set("spark.sql.codegen.wholeStage", "false")
    return side


def is_stored(spark: SparkSession, name: str, source: str) -> bool:
    """Whether this application has made the named table."""
    return (spark.sparkContext.applicationId, name, source) in _made


def stored(spark: SparkSession, name: str, source: str, build: Callable[[SparkSession], DataFrame]) -> DataFrame:
    """The named table derived from ``source``; made on first use in this application."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _made:
        root, df = shared_root(spark), build(side_session(spark))
        if root:
            path = f"{root}/fieldaudit/{key[0]}/{len(_made)}-{name.partition(':')[0]}"
            df.write.mode("overwrite").parquet(path)
        else:
            path = None
            df.persist(StorageLevel.MEMORY_AND_DISK).count()
        _made[key] = path
    # All sessions of an application share what is persisted: the same derivation is answered from there.
    return spark.read.parquet(_made[key]) if _made[key] else build(spark)


def cut(df: DataFrame) -> DataFrame:
    """A frame that a loop builds on: a reliable checkpoint in the shared folder, or persisted with its lineage."""
    root = shared_root(df.sparkSession)
    if not root:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    df.sparkSession.sparkContext.setCheckpointDir(root)
    return df.checkpoint()
