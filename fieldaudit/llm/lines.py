"""Removal of lines that repeat across documents (operator 13).

Two Bloom filters are built over the hashes of all lines: *once* holds every hash, *twice* those that came up in a second document.
A task fills both for its own documents; two tasks' filters merge without their lines, since what stands in both once-filters was
seen twice:  ``once = a | b``,  ``twice = a2 | b2 | (a & b)``.  Filters are cut into segments, so that merging is a grouping by
segment, in two rounds, of compressed bits.

The merged twice-filter goes to the tasks as a broadcast of at most ``MOST_BITS`` bits (64 MB). A line that misses it stands in one
document only and is done with. Documents with other lines are written down; only the digests of these suspected lines are
shuffled, counted exactly, and meet the documents again. A filter that gets too small for a table makes more suspects and no
wrong results: the work then turns into the plain shuffle of 16-byte digests of lines.

A digest that holds more than 1 in ``HOT`` of all repeats (fewer than ``HOT`` of them exist) reaches its documents by broadcast;
all others are joined, so that no join key holds more than that share.

Defined cases: null and empty texts have one empty line and stay as they are; every row counts as a document, rows with one id
too; the lines stay in all rows that have the largest id (null is less than every id; where no row has an id, they stay in all);
equal lines of one text count once and stay or go together; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from fieldaudit.llm.common import giving_back, keep

BLANK = b" \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
BITS_A_LINE = 16
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
SEGMENT = 1 << 17
HOT = 1000
FOUND = "struct<n_lines: long, digests: array<binary>>"
PARTS = "part int, segment int, once binary, twice binary"
PARTS_ARROW = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def keys_of(text: str | None, min_chars: int) -> list[bytes | None]:
    """For every line its key, or None where the key is too short to count."""
    keys = [line.strip(BLANK) for line in (text or "").encode().lower().split(b"\n")]
    return [k if len(k) >= min_chars and (k.isascii() or len(k.decode()) >= min_chars) else None for k in keys]


def digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


class Bits:
    """A Bloom filter's shape: the places of a hash among ``size`` bits (a power of two)."""

    def __init__(self, size: int, lines: int):
        self.size = size
        self.hashes = max(1, min(6, int(0.69 * size / max(lines, 1))))

    @classmethod
    def of(cls, lines: int, most: int = MOST_BITS) -> Bits:
        return cls(min(most, max(LEAST_BITS, 1 << (BITS_A_LINE * max(lines, 1) - 1).bit_length())), lines)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        every = hashes[:, None] + step[:, None] * np.arange(self.hashes, dtype=np.uint64)
        return (every & np.uint64(self.size - 1)).astype(np.int64)

    def empty(self) -> np.ndarray:
        return np.zeros(self.size // 8, np.uint8)

    def has(self, bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        places = self.places(hashes)
        return ((bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=1)

    def put(self, bits: np.ndarray, hashes: np.ndarray) -> None:
        places = self.places(hashes).ravel()
        np.bitwise_or.at(bits, places >> 3, np.left_shift(1, places & 7).astype(np.uint8))

    def see(self, once: np.ndarray, twice: np.ndarray, hashes: np.ndarray) -> None:
        """Takes the hashes of documents, each document's once."""
        distinct, counts = np.unique(hashes, return_counts=True)
        self.put(twice, distinct[(counts > 1) | self.has(once, distinct)])
        self.put(once, distinct)


def packed(part: int, filters: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for segment, (once, twice) in filters.items():
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((part, segment, pack(once.tobytes()), pack(twice.tobytes())), PARTS_ARROW)],
                                         schema=PARTS_ARROW)


def own_filters(docs: DataFrame, text: str, shape: Bits, min_chars: int) -> DataFrame:
    """Both filters of every task, in segments; segments without a bit are left out."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = shape.empty(), shape.empty()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(k, 256).to_pylist()
                hashes = [xxh3_64_intdigest(key) for t in texts for key in set(keys_of(t, min_chars)) if key is not None]
                if hashes:
                    shape.see(once, twice, np.array(hashes, np.uint64))
        parts = {s: (a, b) for s, (a, b) in enumerate(zip(once.reshape(-1, SEGMENT), twice.reshape(-1, SEGMENT))) if a.any()}
        yield from packed(TaskContext.get().partitionId(), parts)

    return docs.select(text).mapInArrow(giving_back(build), PARTS)


def merged(filters: DataFrame, groups: int) -> DataFrame:
    """The filters of every segment and part modulo ``groups`` in one row; a task holds its segments and nothing else."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                part, segment, *bits = (batch.column(k)[row].as_py() for k in range(4))
                once, twice = (np.frombuffer(unpack(b), np.uint8) for b in bits)
                key = part % groups, segment
                if key not in held:
                    held[key] = once.copy(), twice.copy()
                else:
                    a, b = held[key]
                    b |= twice
                    b |= a & once
                    a |= once
        for (part, segment), both in held.items():
            yield from packed(part, {segment: both})

    return filters.repartition((F.col("part") % groups).alias("p"), F.col("segment")).mapInArrow(merge, PARTS)


def twice_filter(docs: DataFrame, text: str, min_chars: int, most: int = MOST_BITS) -> tuple[Bits, bytes]:
    """The shape and the bits of the merged twice-filter."""
    ends = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    long_lines = F.least(ends + 1, F.expr(f"octet_length(`{text}`) div {min_chars}"))
    shape = Bits.of(docs.select(long_lines.alias("n")).agg(F.sum("n")).first()[0] or 0, most)
    found = merged(merged(own_filters(docs, text, shape, min_chars), 16), 1)
    bits = shape.empty().reshape(-1, SEGMENT) if shape.size // 8 >= SEGMENT else shape.empty().reshape(1, -1)
    for segment, twice in found.select("segment", "twice").collect():
        bits[segment] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(twice)), np.uint8)
    return shape, bits.tobytes()


def prober(shape: Bits, shared, min_chars: int):
    @F.pandas_udf(FOUND)
    @giving_back
    def probe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bits = np.frombuffer(shared.value, np.uint8)
        for texts in batches:
            counts, found = [], []
            for text in texts:
                keys = keys_of(text, min_chars)
                counts.append(len(keys))
                distinct = list({k: None for k in keys if k is not None})
                hit = shape.has(bits, np.array([xxh3_64_intdigest(k) for k in distinct], np.uint64)) if distinct else ()
                found.append([digest(k) for k, h in zip(distinct, hit) if h])
            yield pd.DataFrame({"n_lines": counts, "digests": found})

    return probe


def dropper(min_chars: int):
    @F.pandas_udf("struct<text: string, n_dropped: long>")
    def drop(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            rows = []
            for text, gone in zip(texts, lists):
                gone = set() if gone is None else {bytes(d) for d in gone}
                if not gone:
                    rows.append((text, 0))
                    continue
                lines = text.split("\n")
                kept = [line for line, key in zip(lines, keys_of(text, min_chars)) if key is None or digest(key) not in gone]
                rows.append(("\n".join(kept), len(lines) - len(kept)))
            yield pd.DataFrame(rows, columns=["text", "n_dropped"])

    return drop


def repeated(suspects: DataFrame, min_docs: int) -> DataFrame:
    """(rid, digests): the lines to drop from every suspected row (rid, id, digests)."""
    lines = suspects.select("rid", "id", F.explode("digests").alias("digest"))
    found = keep(lines.groupBy("digest").agg(F.count("*").alias("c"), F.max("id").alias("last")).where(F.col("c") >= min_docs), "line-repeats")
    total = found.agg(F.sum("c")).first()[0] or 0
    hot = F.col("c") * HOT > total
    of = lambda few: lines.join(few.drop("c"), "digest").where(~F.col("id").eqNullSafe(F.col("last")))
    gone = of(F.broadcast(found.where(hot))).unionByName(of(found.where(~hot)))
    return gone.groupBy("rid").agg(F.collect_set("digest").alias("gone"))


def line_repeats(docs: DataFrame, text: str = "text", id_column: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                 most_bits: int = MOST_BITS) -> DataFrame:
    """One row per document: ``row`` (all its columns), n_lines, n_dropped and ``kept`` (its text without the repeated lines)."""
    shape, bits = twice_filter(docs, text, min_chars, most_bits)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    probed = docs.select(F.struct("*").alias("row"), prober(shape, shared, min_chars)(F.col(text)).alias("found"))
    alone = probed.where(F.size("found.digests") == 0)
    alone = alone.select("row", "found.n_lines", F.lit(0).cast("long").alias("n_dropped"), F.col("row")[text].alias("kept"))
    suspects = keep(probed.where(F.size("found.digests") > 0)
                    .select(F.monotonically_increasing_id().alias("rid"), "row", "found.n_lines", "found.digests"), "line-suspects")
    gone = repeated(suspects.select("rid", F.col("row")[id_column].alias("id"), "digests"), min_docs)
    told = suspects.select("rid", "row", "n_lines").join(gone, "rid", "left")
    told = told.withColumn("done", dropper(min_chars)(F.col("row")[text], "gone"))
    return alone.unionByName(told.select("row", "n_lines", "done.n_dropped", F.col("done.text").alias("kept")))


def without_repeats(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without their repeated lines, all columns as they were."""
    df = line_repeats(docs, text, **options)
    return df.select(*(F.col("kept").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
