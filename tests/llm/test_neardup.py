import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import sentence
from fieldaudit.llm import neardup as nd
from fieldaudit.llm.graph import components


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def plain(rows, percent):
    """Least id of each group, by comparing all pairs; ids are distinct and not null."""
    sets = {i: shingle_set(t) for i, t, _ in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def copy_of(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out, k = [], 0
    for n in (6, 9, 30, 120, 120, 800):
        original = sentence(rng, n, 3_000)
        for edits in (0, 0, 0, 1, 1, 1, 2, 2, 3, 4, 6, 9):
            out.append((k, copy_of(rng, original, edits), "a"))
            k += 1
    hub = sentence(rng, 150, 3_000)  # copies that are linked to the original and seldom to each other
    out += [(k + j, copy_of(rng, hub, 1 + j % 4), "hot") for j in range(150)] + [(k + 150, hub, "hot")]
    passage = sentence(rng, 60, 3_000)
    out += [(1000 + j, f"{passage} {sentence(rng, rng.randrange(2, 40), 3_000)}", "b") for j in range(60)]
    out += [(2000, "", "a"), (2001, None, "a"), (2002, " \n", None), (2003, "a b", "a"), (2004, "A  B", "a"), (2005, "a b c d e", "a"), (2006, "a b c d", "a")]
    out += [(2010 + j, sentence(rng, rng.randrange(1, 60), 40), "c") for j in range(60)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("percent", [85, 80])
def test_equals_all_pairs(docs_of, rows, percent):
    got = {r.key: (r.n_shingles, r.component_id) for r in nd.near_duplicates(docs_of(rows, clash=True), percent=percent).collect()}
    assert got == plain(rows, percent)


def test_one_of_each_stays(docs_of, rows):
    df = docs_of(rows, clash=True)
    out = nd.one_of_each(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, (_, c) in plain(rows, 85).items() if i == c)


def test_awkward_rows(docs_of, awkward):
    got = nd.near_duplicates(docs_of(awkward, clash=True)).collect()
    assert len(got) == len(awkward)
    by_id = {r.key: r for r in got}
    assert by_id[7].component_id == 6 and by_id[8].component_id == 8 and by_id[None].component_id is None
    assert by_id[1].n_shingles == by_id[3].n_shingles == 0 and by_id[9].n_shingles == 1


def test_same_id_with_other_texts(docs_of):
    rng = random.Random(1)
    a, b = sentence(rng, 50), sentence(rng, 50)
    got = nd.near_duplicates(docs_of([(1, a, "a"), (1, b, "a"), (2, b, "a"), (3, a, "a")])).collect()
    assert sorted((r.key, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_empty_table(docs_of):
    assert nd.near_duplicates(docs_of([])).count() == 0


def test_lookup_by_shuffle_gives_the_same(docs_of, rows, monkeypatch):
    monkeypatch.setattr(nd, "lookup", lambda ids: ids)
    got = {r.key: (r.n_shingles, r.component_id) for r in nd.near_duplicates(docs_of(rows)).collect()}
    assert got == plain(rows, 85)


def plain_signature(items, slots):
    """SuperMinHash one element after another."""
    sign = [(1 << 64) - 1] * slots
    for x in items:
        order = list(range(slots))
        for level in range(slots):
            draw = int(nd.mixed(np.array([int(x) + int(nd.step(level + 1)) & (1 << 64) - 1], np.uint64))[0])
            k = level + ((draw & 0xFFFFFFFF) * (slots - level) >> 32)
            order[level], order[k] = order[k], order[level]
            sign[order[level]] = min(sign[order[level]], level << 32 | draw >> 32)
    return sign


def test_signatures_equal_the_plain_algorithm():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 7, 40, 300, 3)]
    got = nd.superminhash(sets)
    for s, row in zip(sets, got):
        assert row.tolist() == plain_signature(s, nd.SLOTS)


def test_agreement_of_signatures_estimates_similarity():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.85, 0.95):
        est = []
        for _ in range(30):
            u = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            k = int(400 * share)
            half = (400 - k) // 2
            a, b = nd.superminhash([np.unique(u[:k + half]), np.unique(np.r_[u[:k], u[k + half:]])])
            est.append((a == b).mean())
        assert abs(np.mean(est) - share) < 0.02


def test_order_of_words_never_collides():
    words = nd.Words()
    rng = random.Random(9)
    texts = {" ".join(rng.choice("ab") for _ in range(5)) for _ in range(400)}
    assert len({int(nd.shingles(t, words)[0]) for t in texts}) == len(texts)


def test_components(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    parent = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(parent[a], parent[b])
            changed |= parent[a] != m or parent[b] != m
            parent[a] = parent[b] = m
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: m for n, m in parent.items() if n != m}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert components(spark.createDataFrame([(1, 1)], "u long, v long").select(F.col("u"), F.col("v"))).count() == 0


def test_rows_without_id_and_repeated_rows(docs_of):
    rng = random.Random(12)
    a, b, c, d = (sentence(rng, 100, 3_000) for _ in range(4))
    near = copy_of(rng, c, 1)
    bridge = d.split()
    left, right = " ".join([*("l" * k for k in range(1, 8)), *bridge[7:]]), " ".join([*bridge[:-7], *("r" * k for k in range(1, 8))])
    rows = [(5, a, "a"), (None, a, "a"), (None, copy_of(rng, a, 1), "a"), (None, copy_of(rng, a, 1), "a"),  # copies of a document with an id
            (7, b, "a"), (7, b, "a"), (7, b, "b"), (8, b, "a"),  # repeated rows
            (None, c, "a"), (None, c, "a"), (None, near, "a"), (None, near, "a"),  # no id at all
            (20, left, "a"), (21, right, "a"), (None, d, "a"),  # linked over a text without an id
            (30, "", "a"), (30, "", "a"), (None, None, "a"), (None, "", "a"), (None, None, "a")]
    df = docs_of(rows, clash=True)
    got = nd.near_duplicates(df).collect()
    assert sorted((-1 if r.component_id is None else r.component_id) for r in got if r.n_shingles) == [-1] * 4 + [5] * 4 + [7] * 4 + [20] * 3
    assert sum(r.stays for r in got if r.n_shingles) == 4
    out = nd.one_of_each(df).collect()
    full = [(r.doc_id, r.text) for r in out if r.text]
    assert len(full) == 4 and {(5, a), (7, b), (20, left)} < set(full) and any(i is None and t in (c, near) for i, t in full)
    assert sum(not r.text for r in out) == 5


def test_another_text_of_a_repeated_id_stays(docs_of):
    rng = random.Random(13)
    a, b = sentence(rng, 50), sentence(rng, 50)
    assert sorted((r.doc_id, r.text) for r in nd.one_of_each(docs_of([(0, a, "a"), (1, a, "a"), (1, b, "a")])).collect()) == [(0, a), (1, b)]
