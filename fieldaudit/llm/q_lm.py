from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldaudit.llm.common import table
from fieldaudit.llm.lm import scores


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document."""
    df = scores(table(spark, sf_dir, "documents"))
    return df.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op10_lm_scores": op10_lm_scores}
