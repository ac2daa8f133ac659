"""SRC1-SRC10."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldaudit.functions.bits import content_digest
from fieldaudit.sources import schema
from fieldaudit.sources.json_object import json_object


def flat_manifest(spark: SparkSession, path) -> DataFrame:
    """SRC1. Header CSV; a byte-order mark is tolerated, column order is that of the file."""
    return spark.read.schema(schema.FLAT_MANIFEST).option("header", True).csv(path)


def manifest(spark: SparkSession, path) -> DataFrame:
    """SRC2. Nested JSON lines; blank lines are skipped."""
    return spark.read.schema(schema.MANIFEST).json(path)


def records(spark: SparkSession, path) -> DataFrame:
    """SRC2 for identity records."""
    return spark.read.schema(schema.RECORD).json(path)


def predictions(spark: SparkSession, path) -> DataFrame:
    """SRC3. Columns of the file with ``decision`` and ``score`` typed where present.

    Unparsable numbers become null, which the coverage check then reports.
    """
    raw = spark.read.option("header", True).csv(path)
    if "image_id" not in raw.columns or not {"decision", "score"} & set(raw.columns):
        raise ValueError("prediction file needs image_id and a decision or score column")
    types = {"decision": "int", "score": "double", "label": "int"}
    return raw.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in raw.columns})


def seed_scores(spark: SparkSession, paths, seed_pattern: str = r"seed(\d+)") -> DataFrame:
    """SRC4. Score files of several seeds as one long table; the seed comes from the path."""
    df = spark.read.schema(schema.SCORES).option("header", True).csv(paths)
    tiles = F.array(*[F.col(f"tile{i}") for i in range(15)])
    return df.select(
        "image_id", "split", "doc_type", "forgery_category", "label", "logit", "top_tile", tiles.alias("tiles"),
        F.regexp_extract(F.col("_metadata.file_path"), seed_pattern, 1).cast("int").alias("seed"))


def rule_decisions(spark: SparkSession, path) -> DataFrame:
    """SRC5. Rule decisions with failed checks as arrays."""
    df = spark.read.schema(schema.RULE_DECISIONS).option("header", True).csv(path)
    failed = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: x != "").alias(c)
    return df.select(*[failed(c) if c.endswith("failed_checks") else c for c in df.columns])


def parameters(spark: SparkSession, path, declared: T.StructType | str) -> DataFrame:
    """SRC6. One-document JSON parameter file."""
    return spark.read.schema(declared).option("multiLine", True).json(path)


def files(spark: SparkSession, root, pattern: str = "*") -> DataFrame:
    """SRC7. Files below a folder with size and digest, paths relative to it."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    relative = F.regexp_replace("path", r"^.*?" + re.escape(str(root).rstrip("/")) + "/", "")
    return df.select(relative.alias("file"), F.col("length").alias("bytes"), content_digest(F.col("content")).alias("sha"))


def hash_list(spark: SparkSession, path) -> DataFrame:
    """SRC8. ``hash path`` lines; blank lines and # comments are skipped."""
    df = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    parts = F.split(F.trim("value"), r"\s+", 2)
    return df.select(parts[0].alias("sha"), parts[1].alias("file"))


def epochs(spark: SparkSession, path) -> DataFrame:
    """SRC9."""
    return spark.read.schema(schema.EPOCHS).json(path)


def split_map(spark: SparkSession, path) -> DataFrame:
    """SRC10. JSON object person -> split, as rows; a large object is read in byte ranges by several tasks."""
    return json_object(spark, path).select(F.col("key").alias("person_id"), F.col("value").alias("split"))
