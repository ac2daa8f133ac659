import random

import numpy as np

from conftest_llm import sentence
from fieldaudit.llm import substring as s


def plain_borders(data):
    h = [sum(int(s.GEAR[data[i - k]]) << k for k in range(min(16, i + 1))) * 0x9E3779B1 & 0xFFFFFFFF for i in range(len(data))]
    return [i + 1 for i in range(len(h)) if all(h[i] < h[j] for j in range(max(0, i - s.REACH), min(len(h), i + s.REACH + 1)) if j != i)]


def test_borders_equal_the_plain_rule():
    rng = np.random.default_rng(1)
    for data in (rng.integers(0, 256, 700, np.uint8), np.zeros(90, np.uint8), rng.integers(97, 101, 300, np.uint8), rng.integers(0, 256, 1, np.uint8)):
        assert s.borders(data).tolist() == plain_borders(data)


def test_chunks_cover_the_text():
    for text in ("a", "héllo wörld \U0001f600 " * 40, sentence(random.Random(1), 300)):
        digests, chars = s.chunks_of(text)
        assert chars[0] == 0 and chars[-1] == len(text) and (np.diff(chars) > 0).all() and len(digests) == len(chars) - 1


def test_insertion_moves_few_borders():
    text = sentence(random.Random(2), 400, 3000)
    a = {tuple(d) for d in s.chunks_of(text)[0].tolist()}
    b = {tuple(d) for d in s.chunks_of(text[:500] + "inserted" + text[500:])[0].tolist()}
    assert len(a - b) <= 4


def planted():
    rng = random.Random(3)
    passage = [sentence(rng, 55, 3000) for _ in range(3)]
    rows = [(k, sentence(rng, rng.randrange(100, 200), 3000), "a") for k in range(60)]
    with_it = {}
    for k in range(100, 130):
        text = f"{sentence(rng, rng.randrange(3, 60), 3000)} {passage[k % 3]} {sentence(rng, rng.randrange(3, 60), 3000)}"
        rows.append((k, text, "hot"))
        with_it[k] = passage[k % 3]
    rows += [(140, rows[0][1], "a"), (141, "Licensed under the same terms as all. " + sentence(rng, 60, 3000), "a"), (142, "Licensed under the same terms as all. " + sentence(rng, 60, 3000), "a")]
    return rows, with_it


def test_passages_are_found_and_clean_texts_left_alone(docs_of):
    rows, with_it = planted()
    got = {r.key: r for r in s.passages(docs_of(rows, clash=True)).collect()}
    assert set(got) == set(with_it) | {0, 140}
    texts = {i: t for i, t, _ in rows}
    for k, p in with_it.items():
        (span,) = got[k].passages
        assert texts[k][span.start:span.end] in p + " " or p in texts[k][span.start - 60:span.end + 60]
        assert span.end - span.start > 0.5 * len(p)
        if k < 103:
            assert got[k].n_removed == 0 and got[k].sources == []
        else:
            assert 0.5 * len(p) < got[k].n_removed <= got[k].n_repeated and 100 + (k - 100) % 3 in got[k].sources
    assert got[140].sources == [0] and got[140].n_removed == len(texts[140]) and got[0].n_removed == 0


def test_texts_without_repeats(docs_of):
    rows, with_it = planted()
    df = docs_of(rows, clash=True)
    out = s.without_repeats(df)
    assert out.columns == df.columns
    texts, short = {i: t for i, t, _ in rows}, {r.doc_id: r.text for r in out.collect()}
    assert short[140] == "" and short[0] == texts[0] and short[5] == texts[5]
    assert all((short[k] == texts[k]) == (k < 103) for k in with_it)
    assert all(len(short[k]) < len(texts[k]) - 0.5 * len(p) for k, p in with_it.items() if k >= 103)


def test_awkward_rows(docs_of, awkward):
    got = {r.key: r for r in s.passages(docs_of(awkward, clash=True)).collect()}
    assert got[7].n_removed == len(awkward[6][1]) and got[7].sources == [6] and 1 not in got and 3 not in got
    assert s.passages(docs_of([])).count() == 0
    assert s.without_repeats(docs_of(awkward)).count() == len(awkward)


def plain_passages(rows):
    """By (key, text): the spans of chunks that occur twice or more, chained, and those to cut; plain dictionaries over all chunks."""
    documents = sorted({(i, t) for i, t, *_ in rows if t}, key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    cut = {d: s.chunks_of(d[1]) for d in documents}
    count, where = {}, {}
    for i, t, *_ in rows:
        if t:
            digests, chars = cut[i, t]
            for k, chunk in enumerate(map(tuple, digests.tolist())):
                count[chunk] = count.get(chunk, 0) + 1
                where.setdefault(chunk, set()).add((i, t, int(chars[k])))
    out = {}
    for d in documents:
        digests, chars = cut[d]
        spans, last = [], -1
        for k, chunk in enumerate(map(tuple, digests.tolist())):
            if count[chunk] > 1:
                a, b = int(chars[k]), int(chars[k + 1])
                spans.append([a, b, set()]) if a != last else spans[-1].__setitem__(1, b)
                spans[-1][2].update(x[:2] for x in where[chunk])
                last = b
        spans = [x for x in spans if x[1] - x[0] >= s.LEAST]
        if spans:
            out[d] = spans
    return out


def test_against_the_plain_version(docs_of, awkward):
    """Found passages are equal, and of every repeated chunk exactly one place stays."""
    rng = random.Random(11)
    shared = [sentence(rng, 50, 3000) for _ in range(4)]
    rows = [*awkward, (5, shared[0] + " " + sentence(rng, 30, 3000), "a")]
    for k in range(40):
        key = rng.choice([None, 1, 2, 3, 60 + k])
        rows.append((key, " ".join([sentence(rng, rng.randrange(1, 40), 3000), rng.choice(shared), sentence(rng, 20, 3000), rng.choice(shared + [""])]), "a"))
    df = docs_of(rows)
    marks = {(r.doc_id, r.text): r.m for r in df.select("doc_id", "text", s.mark_of("text").alias("m")).collect()}
    got = {(r.key, r.mark): r for r in s.passages(df).collect()}
    want = plain_passages(rows)
    assert {(i, marks[i, t]): [x[:2] for x in spans] for (i, t), spans in want.items()} == {k: [[p.start, p.end] for p in r.passages] for k, r in got.items()}
    for (i, t), spans in want.items():
        others = {x[0] for span in spans for x in span[2] if x != (i, t)}
        assert set(got[i, marks[i, t]].sources) <= others
    stay = [r for r in s.repeated_chunks(df).collect() if r.stays]
    assert len({(r.first.key, r.first.mark, r.first.start) for r in stay}) == len(stay)


def test_two_texts_with_one_id_and_texts_without_id(docs_of):
    rng = random.Random(5)
    passage = sentence(rng, 60, 3000)
    own = [sentence(rng, 80, 3000) for _ in range(6)]
    rows = [(3, f"{own[0]} {passage} {own[1]}", "a"), (3, own[2], "a"), (5, f"{own[3]} {passage}", "a"),
            (None, f"{own[4]} {passage}", "a"), (None, own[5], "a"), (None, f"{passage} {own[4]}", "a")]
    out = sorted(((r.doc_id is not None, r.doc_id), r.text) for r in s.without_repeats(docs_of(rows)).collect())
    texts = [t for _, t in out]
    assert own[2] in texts and own[5] in texts
    whole = [t for t in texts if passage in t]
    assert len(whole) == 1 and sum(own[4] in t for t in texts) == 1
    got = {(r.key, tuple(r.sources)): r for r in s.passages(docs_of(rows)).collect()}
    assert any(k == 5 and None in sources for k, sources in got) and any(k == 3 and None in sources for k, sources in got)
