import random

import pytest

import corpus_pipeline as cp
from conftest_llm import sentence
from test_decontaminate import plain as plain_hits
from test_neardup import copy_of
from test_neardup import plain as plain_groups
from test_quality import plain_counts
from test_tokens import plain as plain_tokens


@pytest.fixture(scope="module")
def folder(spark, docs_of, tmp_path_factory):
    """A small corpus with copies, junk, benchmark passages and rows without text."""
    rng = random.Random(11)
    prose = lambda n: ". ".join(sentence(rng, 8, 3_000) for _ in range(n)) + "."
    rows = [(k, prose(rng.randrange(8, 30)), rng.choice(("a", "b", "c", None))) for k in range(120)]
    rows += [(200 + k, copy_of(rng, rows[k][1], rng.randrange(3)), "copies") for k in range(30)]
    rows += [(300 + k, prose(40).replace(" ", "$$ "), "junk") for k in range(10)] + [(400, None, "a"), (401, "", None), (402, "short", "a")]
    items = [(k, sentence(rng, 30, 3_000)) for k in range(5)]
    rows += [(500 + k, f"{prose(10)} {items[k % 5][1]} {prose(10)}", "bench") for k in range(12)]
    path = tmp_path_factory.mktemp("corpus")
    docs_of(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_stages_one_after_another(spark, folder):
    """Each stage on what the one before kept, against plain versions."""
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    rng_kept = {i: (t, s) for i, t, s in rows}
    steps = {}
    for name, stage in cp.STAGES[:-1]:
        docs = cp.keep(stage(spark, docs, path), "stage")
        assert docs.columns == columns
        steps[name] = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    good = {i for i, _, _ in steps["quality rules"]}
    assert good == {i for i, (t, _) in rng_kept.items() if not 300 <= i < 500 and plain_counts(t)[0] >= 50}
    groups = plain_groups(steps["quality rules"], 80)
    one = {i for i, (_, c) in groups.items() if i == c}
    assert {i for i, _, _ in steps["near-duplicates"]} == one and len(one) == len(steps["near-duplicates"])
    clean = {i for i in one if plain_hits(rng_kept[i][0], items)[1] == 0}
    assert {i for i, _, _ in steps["decontamination"]} == clean and not clean & set(range(500, 512))
    mixed = [i for i, _, _ in steps["mixing"]]
    assert set(mixed) <= clean and all(mixed.count(i) <= 2 for i in set(mixed))
    from tokenizers import Tokenizer

    want = plain_tokens(steps["mixing"], Tokenizer.from_file(cp.vocabulary()))
    got = sorted((tuple(r) for r in cp.run(spark, path).collect()), key=lambda r: r[1])
    assert got == want


def test_empty_documents(spark, docs_of, folder, tmp_path):
    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_awkward_documents(spark, docs_of, folder, tmp_path):
    """Null ids, repeated rows, copies without an id, a very long text, and columns with names that operators use inside."""
    rng = random.Random(12)
    prose = lambda n: ". ".join(sentence(rng, 8, 3_000) for _ in range(n)) + "."
    rows = [(k, prose(rng.randrange(10, 30)), rng.choice(("a", None))) for k in range(40)]
    rows += [(None, prose(15), "b") for _ in range(6)] + [(None, rows[3][1], "b"), (None, rows[3][1], "c"), rows[5], rows[5], (900, prose(4_000), "a"), (None, None, None), (7, "", "a")]
    df = docs_of(rows, clash=True)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), df.columns
    texts = {t for _, t, _ in rows if t}
    for name, stage in cp.STAGES[:-1]:
        docs = cp.keep(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == columns
        kept = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "quality rules":
            assert {t for _, t in kept} == texts and len(kept) == len(rows) - 2
        elif name in ("near-duplicates", "decontamination"):
            assert sorted(t for _, t in kept) == sorted(texts) and sum(i is None for i, _ in kept) == 6
        else:
            assert {t for _, t in kept} <= texts and all(kept.count(x) <= 2 for x in kept)
    out = cp.run(spark, str(tmp_path)).orderBy("start").collect()
    assert len(out) == len(kept) and sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in kept)
    assert [r.start for r in out] == [sum(x.n_tokens for x in out[:k]) for k in range(len(out))]
