from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldaudit.llm.common import table
from fieldaudit.llm.substring import mark_of, passages


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document repeats: characters, passages (start:end in code points), and the documents where the text stays."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", mark_of("text").alias("row_mark"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    found = passages(docs)
    text = F.array_join(F.transform("passages", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    zero = F.lit(0).cast("long")
    df = rows.join(found, F.col("doc_id").eqNullSafe(F.col("key")) & (F.col("row_mark") == F.col("mark")), "left")
    return df.select("doc_id", "n_chars", F.coalesce("n_repeated", zero).alias("n_repeated"), F.coalesce("n_removed", zero).alias("n_removed"),
                     F.coalesce(text, F.lit("")).alias("passages"), F.coalesce("sources", F.array().cast("array<bigint>")).alias("sources"))


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
