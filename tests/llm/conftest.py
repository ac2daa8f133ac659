import os
import random
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import sentence  # noqa: E402

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators use inside.
CLASHING = ("row", "key", "size", "c", "node", "plan_source", "rank", "pattern", "id", "found", "slot", "posterior", "gone_key", "row_key")



@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of given (doc_id, text, source) rows; with ``clash`` it has extra columns of awkward names."""
    def make(rows, clash=False):
        df = spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], DOCS)
        for name in CLASHING if clash else ():
            df = df.selectExpr("*", f"'x' as `{name}`")
        return df.repartition(3)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls in any column, empty and blank texts, a very long one, repeated rows, texts outside ASCII."""
    rng = random.Random(3)
    long_text = sentence(rng, 30_000, 5_000)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n\x0b\x0c\r ", None), (4, "one", "a"), (5, "One two\nthree", None), (6, long_text, "hot"),
            (7, long_text, "hot"), (8, "héllo wörld ñandú \U0001f600 " * 30, "b"), (8, "héllo wörld ñandú \U0001f600 " * 30, "b"), (None, "no id " * 40, "b"),
            (9, "same " * 300, "hot"), (10, "a\x00b   c d", "b"), (11, "a" * 5_000, None)]
    for k in range(20, 50):
        rows.append((k, sentence(rng, rng.randrange(20, 200)), "hot" if k % 3 else "cold"))
    return rows
