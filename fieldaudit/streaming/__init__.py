"""Rules on streams. The row functions are plain columns, so a streaming frame takes them unchanged.

``arrived`` is what a file stream needs to run in steps: it takes all files that are there, writes to Parquet, and ends; the checkpoint
remembers which files are done and what the state is, so the next call, in this application or another, goes on from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldaudit.functions.fields import with_rule


def validated(stream: DataFrame, doc_type: str = "doc_type", identifier: str = "identifier", name: str = "name") -> DataFrame:
    """Adds the rule result to every arriving row; stateless, so any output mode and sink will do."""
    return with_rule(stream, "rule", doc_type, identifier, name)


def file_stream(spark: SparkSession, path: str, schema, files_a_batch: int = 1000) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def first_arrivals(stream: DataFrame, keys) -> DataFrame:
    """SET7 on a stream: the first row of every key. The state holds the keys seen so far, in the checkpoint."""
    return stream.dropDuplicates(list(keys))


def arrived(stream: DataFrame, out: str, checkpoint: str) -> int:
    """Processes what has arrived and not been processed yet; returns the number of batches. Rows are written exactly once."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len([p for p in query.recentProgress if p.numInputRows])
