"""Alignment of two tokenizers against a plain version that reads whole texts."""

import random
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from fieldaudit.llm import crosstoken
from fieldaudit.llm.q_tokens import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def models():
    return crosstoken.ByteLevel(A), crosstoken.Pieces(B)


def plain(rows, models):
    """Quadratic in the text, whole texts, no dictionaries."""
    a_model, b_model = models
    found, counts = [], Counter()
    for i, text, *_ in rows:
        groups, a, b = [], [], []
        if text:
            a, b = a_model.encode([text])[0].tolist(), b_model.model.encode(text)
            if any(b"".join(m.bytes[k] for k in ids) != b" " + text.encode() for m, ids in zip(models, (a, b))):
                a, b = [], []
        links, pos_a, pos_b, ga, gb, p, q = [], 0, 0, [], [], 0, 0
        while p < len(a) or q < len(b):
            if pos_a <= pos_b:
                ga.append(a[p])
                pos_a += len(a_model.bytes[a[p]])
                p += 1
            else:
                gb.append(b[q])
                pos_b += len(b_model.bytes[b[q]])
                q += 1
            if pos_a == pos_b:
                groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
                links.append((ga[-1], gb[-1]))
                ga, gb = [], []
        counts.update(links)
        found.append((i, len(a), len(b), len(groups), links, sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(((i, na, nb, ng, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest)
                   for i, na, nb, ng, links, digest in found), key=str)


def given(df, models, **options):
    digest = F.when(F.col("found.groups") == "", "").otherwise(F.sha2("found.groups", 256)).alias("digest")
    got = crosstoken.with_pair_counts(df, A, B, models[1].size, ["row.doc_id", "found.n_a", "found.n_b", "found.n_groups", "found.n_links", digest], **options)
    got = got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "digest")
    return sorted((tuple(r) for r in got.collect()), key=str)


ODD = ["a  b\tc\nd", "  two spaces  first and last  ", "one\n two\n\n  three \n", "<|endoftext|> <s> </s> <unk> <0x41>", "mark ▁ here", "tail ", " ", "\n", "\x00 \x1f\x1c x",
       "don't I'll 's 've  nbsp em　wide", "日本語のテキスト \U0001f600\U0001f468‍\U0001f469 ﬁ ｆｕｌｌ Å", "é é ñ", "12345 3.14 #!?...", "x" * 3000, "café au lait "]


def test_ranked_encoder_equals_the_library(models):
    rng = random.Random(5)
    assert models[0].ranked
    texts = ODD + ["".join(rng.choice(["a", "b", " ", " ", "\n", "\t", "'s", "é", ".", "7", " ", "\x1f", "word", "▁", "<|endoftext|>"]) for _ in range(rng.randrange(1, 40)))
                   for _ in range(1500)]
    plain = crosstoken.ByteLevel(A)
    plain.ranked = None
    assert [x.tolist() for x in models[0].encode(texts)] == [x.tolist() for x in plain.encode(texts)]


def test_lossless_tokens_spell_any_text(models):
    assert models[0].lossless and not models[1].lossless
    for text, ids in zip(ODD, models[0].encode(ODD)):
        assert b"".join(models[0].bytes[k] for k in ids) == b" " + text.encode()


def test_given_texts(spark, models, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain(rows, models)
    assert sum(r[1] for r in want) > 100_000
    assert given(df, models) == want


@pytest.mark.parametrize("most", [1 << 20, 40, 0])
def test_awkward_rows(docs_of, awkward, models, most):
    rows = [*awkward, *((100 + k, t, "s") for k, t in enumerate(ODD)), *((200, "the same text", "s") for _ in range(30))]
    assert given(docs_of(rows, clash=True), models, most=most) == plain(rows, models)


def test_empty_table(docs_of, models):
    assert given(docs_of([]), models) == []


def test_tokens_without_bytes_share_an_end():
    cuts = crosstoken.slices([1, 1, 3], [1, 1, 1, 3])
    assert [c.tolist() for c in cuts] == [[2, 3], [3, 4]]
    assert crosstoken.links_of([1, 1, 3], [1, 1, 1, 3], *cuts) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 3)]
    assert crosstoken.links_of([2, 3], [1, 2, 3], *crosstoken.slices([2, 3], [1, 2, 3])) == [(0, 1), (1, 2)]
