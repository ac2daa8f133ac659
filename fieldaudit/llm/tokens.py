"""Token-id files with a shared zstandard dictionary (operator 5).

A data set is a folder of ``*.ids`` files, one dictionary, and a manifest (Parquet) that names the files in order. A file is

    frames             one zstandard frame per document: its ids as little-endian integers of 2 or 4 bytes
    index              int64 document ids [n], uint64 frame offsets [n + 1], uint64 running counts of ids [n + 1]
    trailer            the dictionary's sha256 [32], width of an id [1], n [8], offset of the index [8], magic [8]

so that one document is read with three short reads. The dictionary is trained on the id arrays of a bounded sample
(``SAMPLE_DOCS`` documents, of each at most ``SAMPLE_IDS`` ids); everything else covers all rows.

Documents are dealt by ranges of their id, sorted, encoded and written in one pass: texts cross the network once, ids never.
A task writes under names of its own, and the manifest lists the files of the tasks that succeeded: a task that is run again
leaves unlisted files behind, and nothing else. Files are opened with pyarrow's file systems, in the shared folder.

Defined cases: a null text is empty and has the end id only; a null document id comes first and is stored as the least int64;
equal ids stay together, ordered by text; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldaudit.llm.common import giving_back, keep, new_path

MAGIC = b"IDFRAME1"
TRAILER = struct.Struct("<32sBQQ8s")
NO_ID = -(1 << 63)
SAMPLE_DOCS = 2_000
SAMPLE_IDS = 4_096
DICTIONARY_BYTES = 64 * 1024
FILE_BYTES = 256 * 1024 * 1024
#: A worker forgets its words, or their parts, beyond so many bytes of each; they are encoded again when they come back.
CACHE_BYTES = 64 * 1024 * 1024
ENTRY_BYTES = 240
LEVEL = 3
MANIFEST = "part int, seq int, path string, docs long, tokens long, dictionary string"


#: Words of letters that have one code point in normal form, with a tail of marks: their letters are one piece for the model.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|%$#&*()\"-]*)").fullmatch
#: The printable characters that byte-level models use for the 256 bytes: a byte's own where that is printable, else the next free.
_own = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: b for b in _own} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_own)))}


class Known(dict):
    """Values of a function, worked out at the first look."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, key: bytes) -> bytes:
        self[key] = value = self.function(key)
        return value


class Encoder:
    """Ids of whole texts. With ``by_word``, words between ASCII white space are encoded once and looked up afterwards.

    That equals encoding whole texts only for a tokenizer that drops white space and never joins characters across it. Where the
    tokenizer lower-cases and cuts between letters and marks, plain words skip its normaliser and go straight to its model; that
    is tried on a few words first.
    """

    def __init__(self, path: str, end_id: int, by_word: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.end = array("I", [end_id]).tobytes()
        self.by_word = by_word
        self.words = Known(self._word)
        self.parts: dict[str, bytes] = {}
        probe = ["Hello", "wörld,", "ÀÉß!!", "a", "Zebra-", "ÿ(", "don\"", "xylophon&&&"]
        self.direct = False
        self.direct = by_word and [self._plain(PLAIN(w)) for w in probe] == self._encode(probe)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, word: re.Match) -> bytes:
        letters, tail = word[1].lower(), word[2]
        if letters not in self.parts:
            pieces = self.tokenizer.model.tokenize(letters.encode().decode("latin-1").translate(BYTE_CHARS))
            self.parts[letters] = array("I", [t.id for t in pieces]).tobytes()
        if tail and tail not in self.parts:
            self.parts[tail] = self._encode([tail])[0]
        return self.parts[letters] + (self.parts[tail] if tail else b"")

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        plain = self.direct and PLAIN(text)
        return self._plain(plain) if plain else self._encode([text])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 4-byte ids of each text, with the end id."""
        if not self.by_word:
            return [ids + self.end for ids in self._encode(texts)]
        for known in (self.words, self.parts):
            if len(known) * ENTRY_BYTES > CACHE_BYTES:
                known.clear()
        return [b"".join(map(self.words.__getitem__, self._bytes(t).split())) + self.end for t in texts]

    def _bytes(self, text: str) -> bytes:
        """The text's bytes; where the tokenizer lower-cases anyway, A-Z first, so that fewer words are new."""
        raw = text.encode()
        return raw.lower() if self.direct and b"<|" not in raw else raw


@lru_cache(1)
def worker_encoder(path: str, end_id: int, by_word: bool) -> Encoder:
    """The encoder of a worker process, which keeps its words from one task to the next."""
    return Encoder(path, end_id, by_word)


def pieces(values: Iterable[tuple], limit: int = 1_000_000) -> Iterator[list[tuple]]:
    """Lists of rows with about ``limit`` characters of text (their last value)."""
    part, chars = [], 0
    for row in values:
        part.append(row)
        chars += len(row[-1])
        if chars > limit:
            yield part
            part, chars = [], 0
    if part:
        yield part


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            yield from zip(part.column(0).to_pylist(), (t or "" for t in part.column(1).to_pylist()))


def train_dictionary(arrays: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of the sample, or none where the sample is too small for one."""
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


class Writer:
    """One file of frames; it holds the index only, the frames go out as they come."""

    def __init__(self, folder: str, dictionary: bytes, width: int):
        self.system, root = fs.FileSystem.from_uri(folder)
        self.path = f"{folder}/{uuid.uuid4().hex}.ids"
        self.out = self.system.open_output_stream(f"{root}/{self.path.rpartition('/')[2]}")
        self.pack, self.hash, self.width = compressor(dictionary), hashlib.sha256(dictionary).digest(), width
        self.ids, self.offsets, self.counts = [], [0], [0]

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.width == 2:
            ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        frame = self.pack.compress(ids)
        self.out.write(frame)
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.offsets.append(self.offsets[-1] + len(frame))
        self.counts.append(self.counts[-1] + len(ids) // self.width)

    def close(self) -> tuple[str, int, int]:
        self.out.write(np.array(self.ids, "<i8").tobytes())
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array(self.counts, "<u8").tobytes())
        self.out.write(TRAILER.pack(self.hash, self.width, len(self.ids), self.offsets[-1], MAGIC))
        self.out.close()
        return self.path, len(self.ids), self.counts[-1]


class Reader:
    """Random access to one file: the trailer and the index are read, frames on demand."""

    def __init__(self, path: str, dictionary: bytes):
        system, place = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(place)
        end = self.file.size() - TRAILER.size
        found, self.width, n, index, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, end))
        if magic != MAGIC or found != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path}: not a file of ids, or not of this dictionary")
        raw = self.file.read_at(end - index, index)
        self.ids = np.frombuffer(raw, "<i8", n)
        self.offsets = np.frombuffer(raw, "<u8", n + 1, 8 * n).astype("i8")
        self.counts = np.frombuffer(raw, "<u8", n + 1, 8 * n + 8 * (n + 1)).astype("i8")
        self.unpack = decompressor(dictionary)

    def at(self, k: int) -> np.ndarray:
        frame = self.file.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k]))
        return np.frombuffer(self.unpack.decompress(frame), f"<u{self.width}").astype("<u4")

    def document(self, doc_id: int) -> np.ndarray | None:
        k = int(np.searchsorted(self.ids, doc_id))
        return self.at(k) if k < len(self.ids) and self.ids[k] == doc_id else None


def read_bytes(path: str) -> bytes:
    system, place = fs.FileSystem.from_uri(path)
    with system.open_input_stream(place) as f:
        return f.read()


def sample_dictionary(docs: DataFrame, encoder_of, width: int) -> bytes:
    """Trains on the ids of documents chosen by a hash of their id; see the bounds above."""
    every = max(1, docs.count() // SAMPLE_DOCS)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).limit(SAMPLE_DOCS)

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of()
        for part in pieces(rows_of(batches)):
            ids = [np.frombuffer(x, "<u4")[:SAMPLE_IDS].astype(f"<u{width}").tobytes() for x in encoder.encode([t for _, t in part])]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    return train_dictionary(sorted(bytes(r[0]) for r in some.mapInArrow(giving_back(arrays), "ids binary").collect()))


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, by_word: bool = False) -> DataFrame:
    """Encodes (doc_id, text) into ``folder`` in rising order of doc_id; returns the manifest."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
    encoder_of = lambda: worker_encoder(tokenizer, end_id, by_word)
    dictionary = sample_dictionary(docs, encoder_of, width)
    name = hashlib.sha256(dictionary).hexdigest()
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{name}.dictionary") as f:
        f.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, part = encoder_of(), None, TaskContext.get().partitionId()
        files = []
        for rows in pieces(rows_of(batches)):
            for (doc_id, _), ids in zip(rows, encoder.encode([t for _, t in rows])):
                writer = writer or Writer(folder, shared.value, width)
                writer.add(doc_id, ids)
                if writer.offsets[-1] > FILE_BYTES:
                    files.append(writer.close())
                    writer = None
        if writer:
            files.append(writer.close())
        for seq, (path, n, tokens) in enumerate(files):
            yield pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": path, "docs": n, "tokens": tokens, "dictionary": name}], schema=pa.schema(
                [("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("dictionary", pa.string())]))

    dealt = docs.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return keep(dealt.mapInArrow(giving_back(write), MANIFEST), "token-manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the files."""
    order = Window.partitionBy().orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(order), F.lit(0).cast("long")))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
                       + [("ids", pa.list_(pa.int64()))] * with_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name, start in zip(*(batch.column(k).to_pylist() for k in range(3))):
                reader, rows = Reader(path, read_bytes(f"{folder}/{name}.dictionary")), []
                for k, doc_id in enumerate(reader.ids.tolist()):
                    ids = reader.at(k)
                    rows.append((None if doc_id == NO_ID else doc_id, start + int(reader.counts[k]), len(ids), zlib.crc32(ids.tobytes()))
                                + ((ids.tolist(),) if with_ids else ()))
                    if len(rows) == (64 if with_ids else 4096):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    spread = files.select("path", "dictionary", "start").repartition("path")
    return spread.mapInArrow(giving_back(read), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def tokens_round_trip(docs: DataFrame, tokenizer: str, end_id: int, by_word: bool = False) -> DataFrame:
    """Writes the ids of all documents to a new folder of the shared one, and reads them back."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    manifest = write_tokens(docs, folder, tokenizer, end_id, by_word)
    return read_tokens(spark, manifest, folder)
