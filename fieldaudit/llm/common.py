"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
import gc
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts that split at ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: list[str] = []


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers that were started in another folder import this package; a PYTHONPATH that is set comes first."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session may go without: it gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors reach")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="llm-"))
    return _own_folder[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns memory that a worker no longer uses to the machine: workers stay between tasks, and stages of a pipeline share them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(task):
    """A task's function over batches that gives memory back when the task ends."""
    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def uniform(key: Column, salt: str) -> Column:
    """A draw in (0, 1) that depends only on the key: the same on every rerun, and in any engine with md5."""
    text = F.concat(F.lit(f"{salt}|"), F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
