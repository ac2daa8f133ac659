from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldaudit.llm.common import table
from fieldaudit.llm.tokens import tokens_round_trip

#: The end id that the contract names.
END = 2


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, as read back from the files."""
    return tokens_round_trip(table(spark, sf_dir, "documents"), vocabulary(), END, by_word=True)


QUERIES = {"op5_tokens": op5_tokens}
