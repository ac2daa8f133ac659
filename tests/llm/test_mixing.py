import random
from collections import Counter

import duckdb
import pytest

from conftest_llm import sentence
from fieldaudit.llm import mixing
from fieldaudit.llm.q_mixing import ORACLES


@pytest.fixture(scope="module")
def mixed(docs_of):
    rng = random.Random(2)
    rows = [(k, sentence(rng, rng.randrange(1, 120)), ("hot", "b", "c", "d", None)[min(rng.randrange(9), 4)] if k % 3 else "hot") for k in range(900)]
    return docs_of(rows)


def sql_rows(df):
    con = duckdb.connect()
    pdf = df.select("doc_id", "text", "source").toPandas()  # noqa: F841
    con.execute("create table documents as select doc_id::bigint doc_id, text::varchar as text, source::varchar source from pdf")
    return sorted((r[0], r[1], r[2], round(r[3], 6), r[4], r[5]) for r in con.execute(ORACLES["op7_mixing"]).fetchall())


def spark_rows(df):
    out = mixing.mix(df).select("row.doc_id", "size", "source_size", "target", "taken", "copies").collect()
    return sorted((r[0], r[1], r[2], round(r[3], 6), r[4], r[5]) for r in out)


def test_equals_sql(mixed):
    assert spark_rows(mixed) == sql_rows(mixed)


def test_borders_do_not_depend_on_the_width_of_ranges(mixed, monkeypatch):
    want = spark_rows(mixed)
    monkeypatch.setattr(mixing, "FINE", 3)
    assert spark_rows(mixed) == want


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 500)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    total = 1.5 * 2510
    assert got["a"] == 20.0 and abs(sum(got.values()) - total) < 1e-6
    # weights in order: a 5, b 2, c 1, null 5; a and null stop at twice their size, b at 2000; c takes the rest
    assert got[None] == 1000.0 and got["b"] == pytest.approx(1830.0) and got["c"] == pytest.approx(915.0)


def test_words_come_near_the_targets(mixed):
    rows = mixing.mix(mixed).select("row.source", "size", "target", "taken").collect()
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        assert r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6


def test_awkward_rows(docs_of, awkward):
    df = docs_of(awkward, clash=True)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(awkward) and len(rows[0]["row"]) == len(df.columns)
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in rows)


def test_empty_table(docs_of):
    assert mixing.mix(docs_of([])).count() == 0


def test_nothing_but_empty_texts(docs_of):
    assert [r.taken for r in mixing.mix(docs_of([(1, None, "a"), (2, "", None)])).collect()] == [0, 0]
