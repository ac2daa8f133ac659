"""Substring deduplication by content-defined chunks (operator 8).

A gear hash rolls over the last 16 bytes of a text. A chunk ends where the hash is the least within ``REACH`` bytes on either
side: a rule that looks at some fifty bytes only, so that an insertion moves the borders next to it and no others, and equal
passages are cut alike wherever they stand. Chunks have 41 bytes on average, so a passage of fifty words holds several whole ones.

Chunks are compared by a 128-bit digest. The first half of it is counted over all chunks (eight bytes a chunk cross the network),
and only chunks whose half occurs twice or more are looked at again with digest and place. Neighbouring repeated chunks make a
passage; passages of ``LEAST`` characters or more count, so a stock phrase or a common line alone does not. Of every
repeated chunk the occurrence with the least (key, mark, place) stays, the others are removed. ``mark`` is a 64-bit hash of the text.

Defined cases: a null or empty text has no chunks; a document is a key and a text, so rows that agree in both share their chunks'
fate, and two texts with one key (or without a key) are two documents; null comes before every key, and stands among the sources
where a text without a key holds what stays; a text without a border is one chunk, however long; an empty table gives no rows;
other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldaudit.llm.common import keep

REACH = 20
LEAST = 80
GEAR = np.random.Generator(np.random.PCG64(8)).integers(0, 1 << 32, 256, np.uint32)
MOST = np.uint32(0xFFFFFFFF)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash of the 16 bytes that end at each byte: the sum of their table values, shifted by their distance."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        longer = h.copy()
        longer[k:] += h[:-k] << np.uint32(k)
        h = longer
    return h * np.uint32(0x9E3779B1)


def borders(data: np.ndarray) -> np.ndarray:
    """Byte positions before which a chunk ends: after each hash that is the least within reach."""
    h = np.concatenate([np.full(REACH, MOST), gear_hashes(data), np.full(REACH + 1, MOST)])
    least, width = h, 1
    while 2 * width <= REACH:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[:len(least) - (REACH - width)], least[REACH - width:])
    n = len(data)
    own = h[REACH:REACH + n]
    return np.flatnonzero((own < least[:n]) & (own < least[REACH + 1:REACH + 1 + n])) + 1


def chunks_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Digests (two int64 each) and borders in code points (one more than chunks) of a text."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    chars = np.unique(np.searchsorted(starts, borders(data)))
    chars = np.unique(np.concatenate([[0], chars, [len(starts)]]))
    at = np.append(starts, len(raw))[chars].tolist()
    digests = b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(at, at[1:]))
    return np.frombuffer(digests, "<i8").reshape(-1, 2), chars


def texts_of(column) -> Iterator[tuple[int, str]]:
    for k in range(0, len(column), 64):
        for j, t in enumerate(column.slice(k, 64).to_pylist(), k):
            if t:
                yield j, t


def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [chunks_of(t)[0][:, 0] for _, t in texts_of(batch.column(0))]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["half"])


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, digests, first, last = [], [], [], []
        for j, t in texts_of(batch.column(2)):
            d, chars = chunks_of(t)
            digests.append(d)
            first.append(chars[:-1])
            last.append(chars[1:])
            rows.append(np.full(len(d), j))
        if rows:
            both = np.concatenate(digests)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(pa.array(np.concatenate(rows))) for k in (0, 1)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()),
                 pa.array(np.concatenate(first)), pa.array(np.concatenate(last))], ["key", "mark", "half", "rest", "start", "end"])


def mark_of(text: str):
    """What tells texts with one key apart."""
    return F.xxhash64(F.col(text))


def repeated_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, mark, start, end, first, stays) of every chunk that occurs more than once, by place; ``first``: where it stays."""
    texts = docs.where(F.length(text) > 0)
    seen = texts.select(F.col(text).alias("text")).mapInArrow(halves, "half long").groupBy("half").agg(F.count("*").alias("n"))
    twice = keep(seen.where("n > 1").select("half"), "halves")
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *(T.StructField(n, T.LongType()) for n in ("mark", "half", "rest", "start", "end"))])
    found = texts.select(F.col(key).alias("key"), mark_of(text).alias("mark"), F.col(text).alias("text")).mapInArrow(places, schema)
    found = keep(found.join(twice, "half", "left_semi"), "chunks")
    digest = ["half", "rest"]
    first = found.groupBy(*digest).agg(F.count("*").alias("n"), F.min(F.struct("key", "mark", "start")).alias("first")).where("n > 1").drop("n")
    return found.join(first, digest).select("key", "mark", "start", "end", "first", (here() & (F.col("start") == F.col("first.start"))).alias("stays")).distinct()


def here():
    """Whether a chunk stays in its own document."""
    return F.col("key").eqNullSafe(F.col("first.key")) & (F.col("mark") == F.col("first.mark"))


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """One row per document with repeated passages: key, mark, repeated and removed characters, spans, sources.

    ``passages`` are the repeated spans, ``removed`` those of them to cut; ``sources`` are the keys of other documents whose chunks
    stay. The rows of a window are the repeated chunks of one document.
    """
    chunks = repeated_chunks(docs, key, text)
    order = Window.partitionBy("key", "mark").orderBy("start")
    chunks = chunks.withColumn("begins", (F.coalesce(F.lag("end").over(order), F.lit(-1)) != F.col("start")).cast("long"))
    chunks = chunks.withColumn("passage", F.sum("begins").over(order))
    length = F.col("end") - F.col("start")
    found = chunks.groupBy("key", "mark", "passage").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.when(~F.col("stays"), length).otherwise(0)).alias("gone"),
        F.collect_list(F.when(~F.col("stays"), F.struct("start", "end"))).alias("gone_spans"),
        F.collect_set(F.when(~here(), F.struct(F.col("first.key").alias("key")))).alias("sources"))
    found = found.where(F.col("end") - F.col("start") >= least)
    sources = F.transform(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))), lambda s: s["key"])
    return found.groupBy("key", "mark").agg(
        F.sum(F.col("end") - F.col("start")).alias("n_repeated"), F.sum("gone").alias("n_removed"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("passages"),
        F.array_sort(F.flatten(F.collect_list("gone_spans"))).alias("removed"), sources.alias("sources"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """The documents without the repeated passages that stand elsewhere, with their own columns."""
    cut = keep(passages(docs, key, text, least).where("n_removed > 0").select("key", "mark", "removed"), "removed")

    def shorten(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            out = []
            for t, gone in zip(texts, spans):
                if t is not None and gone is not None:
                    at, parts = 0, []
                    for s in gone:
                        parts.append(t[at:s["start"]])
                        at = s["end"]
                    t = "".join([*parts, t[at:]])
                out.append(t)
            yield pd.Series(out, dtype=object)

    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("row_key"), mark_of(text).alias("row_mark"))
    rows = rows.join(cut, F.col("row_key").eqNullSafe(F.col("key")) & (F.col("row_mark") == F.col("mark")), "left")
    short = F.pandas_udf(shorten, "string")(F.col(f"row.{text}"), F.col("removed"))
    return rows.select(F.col("row").withField(text, F.when(F.col("removed").isNull(), F.col(f"row.{text}")).otherwise(short)).alias("row")).select("row.*")
