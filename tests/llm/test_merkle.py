"""Merkle manifest against a plain tree, and against its SQL on the given table."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from fieldaudit.llm import merkle
from fieldaudit.llm.q_merkle import COLUMNS


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k:k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def way(tree, place):
    out = []
    for level in tree[:-1]:
        first = place - place % 8
        run = level[first:first + 8]
        out.append(("".join(run[:place % 8]), "".join(run[place % 8 + 1:])))
        place //= 8
    return out


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of rows (doc_id, source, lang, n_chars, text)."""
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    for rs in by_lang.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {v: levels([leaf_of(r) for r in by_lang[v]]) for v in langs}
    top = levels([trees[v][-1][0] for v in langs])
    out = []
    for k, v in enumerate(langs):
        for place, r in enumerate(by_lang[v]):
            path = way(trees[v], place) + way(top, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            lower = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            digest = leaf_of((*r[:4], lower)) if bad else leaf_of(r)
            for a, z in path:
                digest = h(a + digest + z)
            out.append((r[0], leaf_of(r), trees[v][-1][0], top[-1][0], h("".join(a + z for a, z in path)), digest))
    return sorted(out, key=str)


def given(df):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bad = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    got = merkle.manifest(df, COLUMNS, "lang", "doc_id", {"text": lower}, bad)
    got = got.select("key", "leaf", "subroot", "root", merkle.proof(F.col("path")), F.element_at("nodes", -1))
    return sorted((tuple(r) for r in got.collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 700])
def test_sizes(spark, n):
    rng = random.Random(n)
    rows = [(k, rng.choice(["a", None]), rng.choice(["en", "en", None, "", "é"]) if n > 2 else "en", k, f"Text {k} É") for k in range(n)]
    assert given(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain(rows)


def test_several_blocks(spark):
    rows = [(k, "s", "en" if k % 50 else "de", None, "A" * (k % 5)) for k in range(2 * merkle.BLOCK + 300)]
    assert given(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_awkward_rows(docs_of, awkward):
    df = docs_of([*awkward, (None, None, None), (None, None, None)], clash=True)
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert given(df) == plain(rows)


def test_empty_table(docs_of):
    assert given(docs_of([])) == []


def test_many_trees(spark):
    rows = [(k, None, f"t{k % 600}", 1, "x") for k in range(1500)]
    assert given(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_versions_share_untouched_nodes():
    base = merkle.build([h(str(k)) for k in range(600)], merkle.height_of(600))
    version = merkle.replaced(base, 77, 4, h("other"))
    nodes = lambda node: [node, *(x for c in node[1] for x in nodes(c))]
    old = {id(x) for x in nodes(base)}
    copies = [x for x in nodes(version) if id(x) not in old]
    assert [x[0] for x in reversed(copies)] == merkle.digests(version, 77, 4) and len(copies) == 5
    assert merkle.digests(base, 77, 4)[0] == h("77")
    assert merkle.fold(h("other"), merkle.siblings(base, 77, 4)) == merkle.digests(version, 77, 4)[1:]
