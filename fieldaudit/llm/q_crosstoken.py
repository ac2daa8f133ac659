from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldaudit.llm.common import table
from fieldaudit.llm.crosstoken import Pieces, with_pair_counts
from fieldaudit.llm.q_tokens import vocabulary


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups, links and their corpus-wide counts of every document, under a byte-level and a piece model."""
    a, b = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    digest = F.when(F.col("found.groups") == "", "").otherwise(F.sha2("found.groups", 256)).alias("groups_sha256")
    df = with_pair_counts(table(spark, sf_dir, "documents"), a, b, Pieces(b).size,
                          ["row.doc_id", "found.n_a", "found.n_b", "found.n_groups", "found.n_links", digest])
    return df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op12_alignment": op12_alignment}
