"""Line removal against a plain version; the filters alone."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from conftest_llm import sentence
from pyspark.sql import functions as F

from fieldaudit.llm.lines import Bits, line_repeats, without_repeats

STRIP = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(STRIP))


def plain(rows):
    rank = lambda i: (i is not None, i or 0)
    count, last = Counter(), {}
    for i, text, *_ in rows:
        for key in {key_of(x) for x in (text or "").split("\n")}:
            if len(key) >= 20:
                count[key] += 1
                last[key] = max(last.get(key, (False, 0)), rank(i))
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (count[key_of(x)] >= 3 and last[key_of(x)] != rank(i))]
        out.append((i, len(lines), len(lines) - len(kept), sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def given(df, **options):
    got = line_repeats(df, **options).select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256))
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    common = ["All rights RESERVED by the owner", "Grüße aus München, Frau Öztürk", "exactly twenty chars", "nineteen characters", "ÄÖÜ äöü ÄÖÜ äöü 20 ch"]
    out = []
    for k in range(300):
        lines = [sentence(rng, rng.randrange(1, 12)) for _ in range(rng.randrange(1, 8))]
        for _ in range(rng.randrange(4)):
            line = rng.choice(common)
            lines.insert(rng.randrange(len(lines) + 1), rng.choice([line, line.upper() if line.isascii() else line, f" \t{line}\x0b\r", line + " "]))
        out.append((k, "\n".join(lines), "s"))
    return out


def test_plain_version(docs_of, rows):
    assert given(docs_of(rows)) == plain(rows)


def test_awkward_rows(docs_of, awkward):
    more = [(None, "no id has this line\nbut this one they do have", "a"), (None, "But this one they do have ", "a"), (5, " but this one they do have", "a"),
            (70, "a line that stands in two rows of one id", "a"), (70, "a line that stands in two rows of one id", "a"), (3, "A line that stands in two rows of one id", None),
            (None, "nobody who holds this has an id", "a"), (None, "nobody who holds this has an id", "a"), (None, "x\nnobody who holds this has an id", "a")]
    rows = [*awkward, *more]
    df = docs_of(rows, clash=True)
    assert given(df) == plain(rows)
    assert without_repeats(df).columns == df.columns


def test_empty_table(docs_of):
    assert given(docs_of([])) == []


def test_filter_that_is_too_small_changes_nothing(docs_of, rows):
    assert given(docs_of(rows), most_bits=1 << 20) == plain(rows)
    texts = [(k, "\n".join(f"line number {k} {j} of a very full filter" for j in range(4000)) + "\nThis line stands in them all", "s") for k in range(60)]
    got = line_repeats(docs_of(texts), most_bits=1 << 20).where("n_dropped != 1").select("row.doc_id", "n_dropped").collect()
    assert [tuple(r) for r in got] == [(59, 0)]


def test_hot_line(docs_of):
    rows = [(k, "the same line in every document\nown line of document number %d" % k, "s") for k in range(3000)]
    assert given(docs_of(rows)) == plain(rows)


def test_filters_merge_to_what_was_seen_twice():
    shape = Bits.of(5000)
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    parts = [hashes[:3000], hashes[2500:], hashes[100:200]]
    filters = []
    for p in parts:
        once, twice = shape.empty(), shape.empty()
        shape.see(once, twice, p)
        filters.append((once, twice))
    once, twice = filters[0]
    for a, b in filters[1:]:
        twice = twice | b | (once & a)
        once = once | a
    assert shape.has(once, hashes).all()
    assert shape.has(twice, hashes[2500:3000]).all() and shape.has(twice, hashes[100:200]).all()
    assert shape.has(twice, np.r_[hashes[200:2500], hashes[3000:]]).mean() < 0.01
