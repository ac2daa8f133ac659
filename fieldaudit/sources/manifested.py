"""A sink whose manifest comes from the writing pass (SNK5, SNK6, SNK10): rows, bytes and digests of exactly what was committed.

Every task writes one Parquet file under a name of its own and reports it in its commit message: the file, its rows and bytes, its
sha256, and a digest of its rows that does not depend on their order. The manifest is written when all tasks have succeeded and
lists their files; files of failed or repeated tasks are in no manifest and are never read. Nothing is read a second time.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MANIFEST = "manifest.jsonl"
FIELDS = "file string, rows long, bytes long, sha string, digest string"


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int
    bytes: int
    sha: str
    digest: str


class Hashed:
    """A file object that takes the digest of what passes through."""

    def __init__(self, out):
        self.out, self.hash, self.size, self.closed = out, hashlib.sha256(), 0, False

    def write(self, data) -> int:
        data = bytes(data)
        self.hash.update(data)
        self.size += len(data)
        self.out.write(data)
        return len(data)

    def tell(self) -> int:
        return self.size

    def flush(self) -> None:
        pass

    def close(self) -> None:
        if not self.closed:
            self.out.close()
            self.closed = True

    def writable(self) -> bool:
        return True

    readable = seekable = lambda self: False


def row_sum(batch: pa.RecordBatch) -> int:
    """The sum of the rows' hashes: the same for the same rows in any order, in any files."""
    total = 0
    for row in zip(*(column.to_pylist() for column in batch.columns)):
        total += int.from_bytes(hashlib.blake2b(repr(row).encode(), digest_size=16).digest(), "big")
    return total


class ManifestedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema):
        self.path, self.row_limit = options["path"].rstrip("/"), int(options.get("row_group", 100_000))
        # A test's switch: the first attempt of this partition fails after it has written.
        self.broken = int(options.get("fail_once", -1))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{uuid.uuid4().hex}.parquet"
        system, root = located(self.path)
        out, writer, rows, total = None, None, 0, 0
        for batch in iterator:
            if writer is None:
                system.create_dir(root, recursive=True)
                out = Hashed(system.open_output_stream(f"{root}/{name}"))
                writer = pq.ParquetWriter(pa.PythonFile(out, mode="w"), batch.schema)
            writer.write_batch(batch, row_group_size=self.row_limit)
            rows += batch.num_rows
            total += row_sum(batch)
        if writer is None:
            return Written(None, 0, 0, "", "0" * 40)
        writer.close()
        out.close()
        if self.broken == context.partitionId() and context.attemptNumber() == 0:
            raise RuntimeError("asked to fail")
        return Written(name, rows, out.size, out.hash.hexdigest(), f"{total % (1 << 160):040x}")

    def commit(self, messages: list) -> None:
        system, root = located(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{MANIFEST}") as f:
            for m in sorted((m for m in messages if m and m.file), key=lambda m: m.file):
                f.write((json.dumps(vars(m)) + "\n").encode())

    def abort(self, messages: list) -> None:
        """Nothing to undo: without a manifest no file counts."""


class Manifested(DataSource):
    @classmethod
    def name(cls) -> str:
        return "manifested"

    def writer(self, schema, overwrite: bool) -> ManifestedWriter:
        return ManifestedWriter(self.options, schema)


def write_manifested(df: DataFrame, path: str, **options) -> DataFrame:
    """Writes to a new folder; returns the manifest. A folder that has a manifest already is an error."""
    spark = df.sparkSession
    system, root = located(path)
    if system.get_file_info(f"{root.rstrip('/')}/{MANIFEST}").type != fs.FileType.NotFound:
        raise ValueError(f"{path} has a manifest already")
    spark.dataSource.register(Manifested)
    df.write.format("manifested").mode("append").option("path", path).options(**options).save()
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FIELDS).json(f"{path.rstrip('/')}/{MANIFEST}")


def read_manifested(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of the files that the manifest lists: their names are one a task."""
    names = [r.file for r in manifest(spark, path).select("file").collect()]
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/{n}" for n in names])


def totals(listed: DataFrame) -> DataFrame:
    """One row: files, rows, bytes and the digest of all rows (the sum of the files' digests, the same however rows are dealt)."""
    digests = [int(r.digest, 16) for r in listed.select("digest").collect()]
    row = listed.selectExpr("count(*) as files", "coalesce(sum(rows), 0) as rows", "coalesce(sum(bytes), 0) as bytes").first()
    return listed.sparkSession.createDataFrame([(*row, f"{sum(digests) % (1 << 160):040x}")], "files long, rows long, bytes long, digest string")
