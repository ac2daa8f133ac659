import random
import re

import pytest

from conftest_llm import sentence
from fieldaudit.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, width=10):
    w = words(text)
    hit, ids = set(), set()
    for item, t in items:
        v = words(t)
        n = min(width, len(v))
        wins = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1 if v else 0):
            if tuple(w[i:i + n]) in wins:
                hit |= set(range(i, i + n))
                ids.add(item)
    return len(w), len(hit), sorted(x for x in ids if x is not None)


@pytest.fixture(scope="module")
def case(spark, awkward):
    rng = random.Random(4)
    items = [(1, sentence(rng, 25)), (2, "One-Two, THREE"), (3, None), (4, "  ... "), (5, "one two three four"), (5, "one two three four"), (None, "w1 w2"),
             (6, "héllo wörld"), (7, "same same same")]
    rows = list(awkward)
    for k in range(200, 230):
        t = items[0][1].split()
        a = rng.randrange(15)
        rows.append((k, f"{sentence(rng, 20)} {', '.join(t[a:a + rng.randrange(8, 14)])} {sentence(rng, 5)}", "a"))
    rows += [(300, "One two  THREE-four!", "a"), (301, "zone two three", "a"), (302, items[0][1].upper(), "a"), (303, "one two three one two three", "a")]
    return rows, items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("limit", [d.BLOCK_CHARS, 40])
def test_equals_brute_force_in_any_blocks(docs_of, case, limit):
    rows, items, benchmark = case
    got = sorted((r.row.doc_id or -1, r.found.n_words, r.found.n_hit, sorted(r.found["items"]))
                 for r in d.contaminated(docs_of(rows, clash=True), benchmark, block_chars=limit).collect())
    assert got == sorted((i or -1, *plain(t, items)) for i, t, _ in rows)


def test_spans_are_places_in_the_original(docs_of, case):
    rows, _, benchmark = case
    texts = {i: t for i, t, _ in rows}
    for r in d.contaminated(docs_of(rows), benchmark).where("found.n_hit > 0 and row.doc_id is not null").collect():
        inside = [w for s in r.found.spans for w in words(texts[r.row.doc_id][s.start:s.end])]
        assert len(inside) == r.found.n_hit
    found = {r.row.doc_id: r.found.spans for r in d.contaminated(docs_of([(1, "ñ é! One, two THREE four. five", "a")]), benchmark).collect()}
    assert [(s.start, s.end) for s in found[1]] == [(5, 24)]


def test_clean_documents_pass_with_their_columns(docs_of, case):
    rows, items, benchmark = case
    df = docs_of(rows, clash=True)
    out = d.clean_documents(df, benchmark)
    assert out.columns == df.columns
    assert out.count() == sum(plain(t, items)[1] == 0 for _, t, _ in rows)


def test_empty_tables(spark, docs_of, case):
    rows, _, benchmark = case
    assert d.contaminated(docs_of([]), benchmark).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(docs_of(rows), none).where("found.n_hit > 0").count() == 0
