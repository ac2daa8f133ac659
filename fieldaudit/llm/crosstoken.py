"""Alignment of the tokens of two tokenizers (operator 12).

Both tokenizers read a space and the text. A dictionary of each takes the byte offsets at which its tokens end to the tokens'
indices; the offsets that both dictionaries hold, sorted, slice the two id lists into groups, and every slice is expanded into its
links: the pairs of an A and a B token that end at the slice's end.

A byte-level file whose merges stand in the order of their ids is read by tiktoken's encoder, which takes ids as ranks and gives
the same ids several times faster; any other goes to the tokenizers library.

How often a pair of ids is linked is counted over the whole corpus, with partial counts in the tasks. The ``MOST_PAIRS`` (at most)
most frequent pairs go to the documents as a broadcast of bounded size; every other pair has fewer occurrences than any of those,
is joined to the documents that hold it, and so makes no hot key. A document's links are written once, as distinct pairs with
their number, and read twice.

Defined cases: null and empty texts, and texts whose tokens do not spell the text byte by byte, have no tokens; tokens without
bytes end where the token before them ends, so several tokens of one side may share an end and give several links; every row is
counted, equal rows too; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldaudit.llm.common import keep
from fieldaudit.llm.tokens import BYTE_CHARS

MOST_PAIRS = 1 << 20
#: Texts go through the tokenizers in lots of about so many characters.
LOT = 500_000
MARK = "▁"
#: Fixed value: how byte-level models cut a text into the parts that merges stay inside of.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """A byte-level model in a file of the tokenizers library; strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte_of = {chr(c): bytes([b]) for b, c in BYTE_CHARS.items()}
        entries = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(entries.values()) + 1
        self.bytes = [b""] * self.size
        for entry, k in entries.items():
            self.bytes[k] = b"".join(byte_of.get(c, c.encode()) for c in entry)
        with open(path, encoding="utf-8") as f:
            self.ranked = self._ranked(json.load(f))
        # Every byte has a token and nothing rewrites the text: the tokens spell it whatever it is.
        self.lossless = self.ranked is not None and {b for b in self.bytes if len(b) == 1} == {bytes([k]) for k in range(256)}

    def _ranked(self, told: dict):
        """tiktoken's encoder, where the file says no more than ids that rise with the merges."""
        import tiktoken

        model, before = told["model"], told.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in (
            "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        cut = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        ids = [model["vocab"][a + b] for a, b in pairs]
        first = 256 + len(ids) == len(model["vocab"]) and min(ids, default=256) == 256
        if told.get("normalizer") or not (plain and cut and first and ids == sorted(set(ids))):
            return None
        return tiktoken.Encoding("ranked", pat_str=CUT, mergeable_ranks={self.bytes[k]: k for k in model["vocab"].values()}, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.ranked:
            return [np.array(self.ranked.encode_ordinary(" " + t)) for t in texts]
        return [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A sentencepiece model that puts a space before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        entries = [self.model.id_to_piece(k) for k in range(self.size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(entries)]

        self.lossless = False

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


def slices(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups end: the indices after the last token of A and of B, for every end that both have, in order."""
    index_a, index_b = dict(zip(ends_a, range(1, len(ends_a) + 1))), dict(zip(ends_b, range(1, len(ends_b) + 1)))
    common = sorted(index_a.keys() & index_b.keys())
    return tuple(np.fromiter(map(index.__getitem__, common), np.int64, len(common)) for index in (index_a, index_b))


def links_of(ends_a: list[int], ends_b: list[int], last_a: np.ndarray, last_b: np.ndarray) -> list[tuple[int, int]]:
    """The linked tokens: in every slice all pairs, by index, of those that end where it ends."""
    out, i, j = [], 0, 0
    for i2, j2 in zip(last_a.tolist(), last_b.tolist()):
        end = ends_a[i2 - 1]
        out += [(p, q) for p in range(i, i2) if ends_a[p] == end for q in range(j, j2) if ends_b[q] == end]
        i, j = i2, j2
    return out


class Aligner:
    def __init__(self, first, second):
        self.a, self.b = first, second
        self.lengths = [np.array([len(x) for x in m.bytes]) for m in (first, second)]
        # How a token is told: with a comma inside its group, with a bar or a semicolon at the end of its side.
        self.told = [f"{k}{mark}" for size, marks in ((first.size, ",|"), (second.size, ",;")) for mark in marks for k in range(size)]

    def pair(self, text: str, a: np.ndarray, b: np.ndarray) -> tuple | None:
        """(tokens of A, of B, groups, groups as text, pairs as numbers), or None where the tokens do not spell the text."""
        want = b" " + text.encode()
        if not all(m.lossless or b"".join(map(m.bytes.__getitem__, ids.tolist())) == want for m, ids in ((self.a, a), (self.b, b))):
            return None
        size_a, size_b = self.lengths[0][a], self.lengths[1][b]
        ends_a, ends_b = size_a.cumsum().tolist(), size_b.cumsum().tolist()
        last_a, last_b = slices(ends_a, ends_b)
        if size_a.all() and size_b.all():
            linked = a[last_a - 1] * self.b.size + b[last_b - 1]
        else:
            linked = np.array([a[p] * self.b.size + b[q] for p, q in links_of(ends_a, ends_b, last_a, last_b)], np.int64)
        return len(a), len(b), len(last_a), self.text(a, b, last_a, last_b), linked

    def text(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """Every token at its place: a token of A after the tokens of B in earlier groups, one of B after those of A up to its group."""
        group_a, group_b = (np.zeros(len(x), np.int64) for x in (a, b))
        group_a[last_a[:-1]] = group_b[last_b[:-1]] = 1
        before_b, upto_a = np.r_[0, last_b[:-1]][group_a.cumsum()], last_a[group_b.cumsum()]
        shift_a, shift_b = np.zeros(len(a), np.int64), np.full(len(b), 2 * self.a.size)
        shift_a[last_a - 1] += self.a.size
        shift_b[last_b - 1] += self.b.size
        place = np.empty(len(a) + len(b), np.int64)
        place[np.arange(len(a)) + before_b] = a + shift_a
        place[np.arange(len(b)) + upto_a] = b + shift_b
        return "".join(map(self.told.__getitem__, place.tolist()))[:-1]

    def align(self, texts: list[str | None]) -> list[tuple | None]:
        """Per text: tokens of A, of B, groups, groups as text, pairs; None without tokens."""
        there = [t for t in texts if t]
        found = iter(map(self.pair, there, self.a.encode(there), self.b.encode(there)))
        return [next(found) if t else None for t in texts]


@lru_cache(1)
def worker_aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(ByteLevel(path_a), Pieces(path_b))


def lots(texts: list[str | None]) -> Iterator[list[str | None]]:
    lot, chars = [], 0
    for t in texts:
        lot.append(t)
        chars += len(t or "")
        if chars > LOT:
            yield lot
            lot, chars = [], 0
    if lot:
        yield lot


ALIGNED = "struct<n_a: long, n_b: long, n_groups: long, n_links: long, groups: string, pairs: binary, times: binary>"


def aligned(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """One row per document: ``row`` (all its columns) and the struct ``found``.

    ``found``: the numbers of tokens, groups and links; ``groups`` as text (``a1,a2|b1;a3|b2,b3``: ids of A, bar, ids of B), and the
    distinct linked pairs (``a * size of B + b``, rising, 8 bytes each) with their ``times`` (4 bytes each).
    """
    types = pa.struct([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()),
                       ("pairs", pa.binary()), ("times", pa.binary())])

    @F.arrow_udf(ALIGNED)
    def align(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        aligner = worker_aligner(path_a, path_b)
        for batch in batches:
            rows = []
            for lot in (lot for k in range(0, len(batch), 256) for lot in lots(batch.slice(k, 256).to_pylist())):
                for found in aligner.align(lot):
                    a, b, groups, told, pairs = found or (0, 0, 0, "", [])
                    distinct, times = np.unique(np.asarray(pairs, np.int64), return_counts=True)
                    rows.append((a, b, groups, len(pairs), told, distinct.astype("<i8").tobytes(), times.astype("<i4").tobytes()))
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types)] if rows else
                                             [pa.array([], f.type) for f in types], fields=list(types))

    return docs.select(F.struct("*").alias("row"), align(F.col(text)).alias("found"))


def pair_counts(links: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best) over rows (pairs, times): links of every pair in the corpus, and whether no other pair of its B id has more."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times, schema = np.empty(0, np.int64), np.empty(0, np.int64), ["pair", "n"]
        for batch in batches:
            new = [np.frombuffer(x, "<i8") for x in batch.column(0).to_pylist()], [np.frombuffer(x, "<i4") for x in batch.column(1).to_pylist()]
            pairs, where = np.unique(np.concatenate([pairs, *new[0]]), return_inverse=True)
            times = np.bincount(where, np.concatenate([times, *new[1]]), len(pairs)).astype(np.int64)
            if len(pairs) > 4 * MOST_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], schema)
                pairs, times = pairs[:0], times[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], schema)

    counts = links.select("pairs", "times").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = keep(counts.withColumn("b", F.col("pair") % size_b), "pair-counts")
    return counts.join(counts.groupBy("b").agg(F.max("n").alias("most")), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def least_told(counts: DataFrame, most: int) -> int:
    """The least count from which on there are at most ``most`` pairs: halving steps over counts by size."""
    sizes = F.floor(F.log2("n")).cast("int")
    by_size = {r[0]: r[1] for r in counts.groupBy(sizes.alias("s")).count().collect()}
    told, least = 0, 0
    for s in sorted(by_size, reverse=True):
        if told + by_size[s] > most:
            return least
        told, least = told + by_size[s], 1 << s
    return 1


def with_pair_counts(docs: DataFrame, path_a: str, path_b: str, size_b: int, columns: list, text: str = "text",
                     most: int = MOST_PAIRS) -> DataFrame:
    """``columns`` (of ``row`` and ``found``) of every document, n_best and count_sum.

    n_best: links whose pair is the most frequent of its B id, ties included; count_sum: the corpus-wide counts over all links.
    """
    done = aligned(docs, path_a, path_b, text).select(F.monotonically_increasing_id().alias("rid"), *columns, "found.pairs", "found.times")
    done = keep(done, "aligned")
    names = [c for c in done.columns if c not in ("rid", "pairs", "times")]
    counts = keep(pair_counts(done, size_b), "pairs")
    least = least_told(counts, most)
    told = counts.where(F.col("n") >= least if least else F.lit(False)).orderBy("pair").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast([told.column(k).to_numpy() for k in range(3)])

    def look(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = shared.value[0]
        at = np.searchsorted(known, pairs)
        inside = at < len(known)
        inside[inside] = known[at[inside]] == pairs[inside]
        return at, inside

    sums = pa.struct([("best", pa.int64()), ("total", pa.int64())])

    @F.arrow_udf("struct<best: long, total: long>")
    def add(pairs: pa.Array, times: pa.Array) -> pa.Array:
        _, n, best = shared.value
        rows = []
        for p, t in zip(pairs.to_pylist(), times.to_pylist()):
            p, t = np.frombuffer(p, "<i8"), np.frombuffer(t, "<i4").astype(np.int64)
            at, inside = look(p)
            at, t = at[inside], t[inside]
            rows.append((int(t[best[at]].sum()), int((t * n[at]).sum())))
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 2, fields=list(sums))

    df = done.withColumn("sums", add("pairs", "times"))
    if least == 1:
        return df.select(*names, F.col("sums.best").alias("n_best"), F.col("sums.total").alias("count_sum"))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, ps, ts = (batch.column(k).to_pylist() for k in range(3))
            for rid, p, t in zip(rids, ps, ts):
                p, t = np.frombuffer(p, "<i8"), np.frombuffer(t, "<i4")
                out = ~look(p)[1]
                if out.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(out.sum(), rid, np.int64)), pa.array(p[out]), pa.array(t[out].astype(np.int64))],
                                                     ["rid", "pair", "t"])

    few = done.select("rid", "pairs", "times").mapInArrow(rare, "rid long, pair long, t long").join(counts.where(F.col("n") < least if least else F.lit(True)), "pair")
    few = few.groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("more_best"), F.sum(F.col("t") * F.col("n")).alias("more"))
    zero = F.lit(0).cast("long")
    return df.join(few, "rid", "left").select(*names, (F.col("sums.best") + F.coalesce("more_best", zero)).alias("n_best"),
                                              (F.col("sums.total") + F.coalesce("more", zero)).alias("count_sum"))
