"""Benchmark decontamination with an Aho-Corasick automaton (operator 2).

Every window of ``width`` consecutive words of a benchmark item (an item with fewer words is one window) becomes a pattern
between two spaces. A document is normalised once, to its words between single spaces, and scanned once; every pattern that
ends at a character is reported there, so overlapping and nested windows cost no further pass. Since lower-casing and
blanking leave every byte where it was, the offset of a word in the normalised bytes is its offset in the original.

The scan is a narrow step: no shuffle, and texts leave a task only as spans. The benchmark reaches the executors in blocks of
at most ``BLOCK_CHARS`` characters of patterns, read one by one through the driver; a scan takes the blocks in turn.

Defined cases: null or wordless texts (documents or items) have no words and no hits; an item that occurs twice under one id
counts once; a null item id marks words but is no item; an empty benchmark hits nothing; further columns pass through.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldaudit.llm.common import giving_back

WIDTH = 10
#: Bound of a block of patterns; an automaton takes some 50 bytes a character.
BLOCK_CHARS = 2_000_000
#: Lower-cases A-Z and turns every other ASCII character that is no word character into a space.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
RESULT = "n_words long, n_hit long, items array<long>, spans array<struct<start: long, end: long>>"

_automaton: dict[str, ahocorasick.Automaton] = {}


def words_of(text: str) -> tuple[bytes, list[bytes]]:
    """The normalised bytes, as long as the text's UTF-8 bytes, and their words."""
    normal = text.encode().translate(NORMAL)
    return normal, normal.split()


def pattern(words: list[bytes]) -> str:
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def windows(text: str, width: int) -> Iterator[tuple[str, int]]:
    words = words_of(text)[1]
    for i in range(max(1, len(words) - width + 1) if words else 0):
        part = words[i:i + width]
        yield pattern(part), len(part)


def blocks(items: Iterable[tuple[int | None, str | None]], width: int, limit: int) -> Iterator[dict[str, tuple[int, set]]]:
    """Patterns with their width in words and their items, in blocks of about ``limit`` characters."""
    block: dict[str, tuple[int, set]] = {}
    chars = 0
    for item, text in items:
        for p, n in windows(text or "", width):
            if p not in block:
                block[p] = (n, set())
                chars += len(p)
            if item is not None:
                block[p][1].add(item)
        if chars > limit:
            yield block
            block, chars = {}, 0
    if block:
        yield block


def automaton(block) -> ahocorasick.Automaton:
    """The automaton of a broadcast (name, patterns); a worker keeps the last one only."""
    name, patterns = block.value
    if name not in _automaton:
        _automaton.clear()
        made = ahocorasick.Automaton()
        for p, found in patterns.items():
            made.add_word(p, found)
        made.make_automaton()
        _automaton[name] = made
    return _automaton[name]


def hits(scan: str, machine: ahocorasick.Automaton) -> Iterator[tuple[int, int, set]]:
    """(first word, word after the last, items) of every pattern that occurs, by its end."""
    at, ended = 0, 0
    for end, (n, items) in machine.iter(scan):
        at += scan.count(" ", ended, end)
        ended = end
        yield at - n, at, items


def merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: str, normal: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Code point offsets in the text as it was, of ranges of words."""
    raw = text.encode()
    places = [m.span() for m in re.finditer(rb"[^ ]+", normal)]
    out, chars, done = [], 0, 0
    for a, b in ranges:
        start, end = places[a][0], places[b - 1][1]
        first = chars + len(raw[done:start].decode())
        chars, done = first + len(raw[start:end].decode()), end
        out.append({"start": first, "end": chars})
    return out


def scanner(broadcast_blocks: list):
    @F.pandas_udf(RESULT)
    @giving_back
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = [t or "" for t in texts]
            found: list[list[tuple[int, int]]] = [[] for _ in texts]
            items: list[set] = [set() for _ in texts]
            for block in broadcast_blocks:
                machine = automaton(block)
                for k, text in enumerate(texts):
                    words = words_of(text)[1]
                    if words:
                        for a, b, ids in hits(pattern(words), machine):
                            if not found[k] or found[k][-1] != (a, b):
                                found[k].append((a, b))
                            items[k] |= ids
            rows = []
            for text, parts, ids in zip(texts, found, items):
                normal, words = words_of(text)
                ranges = merged(parts)
                rows.append((len(words), sum(b - a for a, b in ranges), sorted(ids),
                             original_spans(text, normal, ranges) if ranges else []))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", item_text: str = "text",
                  width: int = WIDTH, block_chars: int = BLOCK_CHARS):
    """A function of a text column: the struct (n_words, n_hit, items, spans) of what a text shares with the benchmark."""
    context = docs.sparkSession.sparkContext
    items = ((r[0], r[1]) for r in benchmark.select(item, item_text).toLocalIterator())
    return scanner([context.broadcast((uuid.uuid4().hex, b)) for b in blocks(items, width, block_chars)])


def digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ","), 256)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """One row per document: ``row`` (all its columns) and the struct ``found``."""
    scan = contamination(docs, benchmark, **options)
    return docs.select(F.struct("*").alias("row"), scan(F.col(text)).alias("found"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents in which no window of the benchmark occurs."""
    return contaminated(docs, benchmark, text, **options).where("found.n_hit = 0").select("row.*")
