from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldaudit.llm.common import table
from fieldaudit.llm.html_text import extracted


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    df = extracted(table(spark, sf_dir, "pages"))
    return df.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op9_html": op9_html}
