from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldaudit.llm.common import table
from fieldaudit.llm.quality import judged


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and whether weak supervision keeps it."""
    df = judged(table(spark, sf_dir, "documents"), carry=("doc_id",))
    return df.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                     F.round("posterior", 6).alias("posterior"))


QUERIES = {"op1_quality_rules": op1_quality_rules}
