"""A training corpus from ``documents``: quality rules, near-duplicates, decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns of
``docs``. run() writes each stage's result to the shared folder and reads it back as the next one's documents.

Defined cases: a row without text, or with an empty one, fails the quality base and goes; rows without an id are documents like any
other, and come first in the token files; of rows that are copies of each other, in id and text too, one stays; texts are worked on
whole, however long; a document that the mix takes twice has two rows, next to each other in the files; columns with other names
pass through up to the last stage, whatever they are called; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldaudit.llm.common import keep, table
from fieldaudit.llm.decontaminate import clean_documents
from fieldaudit.llm.mixing import mixed_documents
from fieldaudit.llm.neardup import one_of_each
from fieldaudit.llm.q_tokens import END, vocabulary
from fieldaudit.llm.quality import good_documents
from fieldaudit.llm.tokens import tokens_round_trip


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and that weak supervision takes to be good."""
    return good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 80 % shared 5-word shingles: the one with the least id."""
    return one_of_each(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no 10-word window of the benchmark occurs."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of the ids of every row, as read back from the files."""
    return tokens_round_trip(docs, vocabulary(), END, by_word=True)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("token files", token_files)]

#: The last stage tokenises, which SQL cannot express; tests/llm/test_pipeline.py holds it against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs, name.replace(" ", "-"))
    return docs
