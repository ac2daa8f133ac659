"""One large JSON object as rows, read by byte ranges (SRC10, and SRC2 for a single huge object).

A range alone cannot tell whether it begins inside a string. So a first job counts the unescaped quotes of every range: the parity of
all quotes before a range says it exactly, whatever the strings hold. A second job reads the ranges again; an entry belongs to the
range that holds the brace or comma before it, and is read on beyond the range's end. The driver sees one number per range.

Values are strings, numbers, true, false or null; a nested value is an error. A key that occurs twice gives two rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STEP = 32 * 1024 * 1024
MOST_TASKS = 10_000
_ESCAPE = re.compile(rb"\\.", re.DOTALL)
_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*"|[,{}\[\]]', re.DOTALL)
_REST = re.compile(rb'(?:[^"\\]|\\.)*"', re.DOTALL)


class Ranges:
    """Reads of one file."""

    def __init__(self, path: str):
        system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.file = system.open_input_file(place)
        self.size = self.file.size()

    def read(self, start: int, end: int) -> bytes:
        return self.file.read_at(min(end, self.size) - start, start) if start < min(end, self.size) else b""

    def escaped(self, start: int) -> bool:
        """Whether the byte at ``start`` follows an odd run of backslashes."""
        run, at = 0, start
        while at > 0:
            before = self.read(max(0, at - 64), at)
            here = len(before) - len(before.rstrip(b"\\"))
            run, at = run + here, at - len(before)
            if here < len(before):
                break
        return run % 2 == 1

    def quotes(self, start: int, end: int) -> int:
        data = self.read(start, end)
        return _ESCAPE.sub(b"", data[self.escaped(start):]).count(b'"')

    def entries(self, start: int, end: int, inside: bool) -> Iterator[tuple[str, str | None]]:
        """The entries after the brace and the commas of a range; ``inside``: the range begins in a string."""
        data, at = self.read(start, end), 0
        limit = len(data)
        if inside:
            at = int(self.escaped(start))
            while not (rest := _REST.match(data, at)):
                more = self.read(start + len(data), start + len(data) + STEP)
                if not more:
                    raise ValueError("a string does not end")
                data += more
            at = rest.end()
        begun, opener = None, b""
        while begun is not None or at < limit:
            token = _TOKEN.search(data, at)
            quote = data.find(b'"', at, token.start() if token else len(data))
            if token is None or quote >= 0:
                # An open string, or nothing more: the range has no further separator. An entry that is open is read on.
                if begun is None:
                    return
                more = self.read(start + len(data), start + len(data) + STEP)
                if not more:
                    raise ValueError("the object does not end")
                data += more
                continue
            mark, at = token.group(), token.end()
            if mark in (b"[", b"]") or (mark == b"{" and (begun is not None or start + token.start() != self.first())):
                raise ValueError("values of the object must not be nested")
            if mark in (b",", b"}") and begun is not None:
                entry = data[begun:token.start()]
                if entry.strip() or opener == b"," or mark == b",":
                    ((key, value),) = json.loads(b"{" + entry + b"}").items()
                    yield key, value if value is None or isinstance(value, str) else json.dumps(value)
                begun = None
            if mark == b"}":
                return
            if mark in (b"{", b",") and token.start() < limit:
                begun, opener = at, mark

    def first(self) -> int:
        """Place of the opening brace, after white space and a byte-order mark."""
        head = self.read(0, 4096)
        at = head.find(b"{")
        if at < 0 or head[:at].removeprefix(b"\xef\xbb\xbf").strip():
            raise ValueError("the file does not hold a JSON object")
        return at


def json_object(spark: SparkSession, path, step: int = STEP) -> DataFrame:
    """(path, key, value) of the objects in a file, or in each file of a folder."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = listed.select("path", F.explode(F.expr(f"sequence(0L, length - 1, {int(step)}L)")).alias("start"))
    # A row stands for a whole range, which the size of a shuffle does not show: the number of tasks is set, so that they stay apart.
    tasks = min(max(listed.agg(F.sum(F.ceil(F.col("length") / step))).first()[0] or 0, 1), MOST_TASKS)
    ranges = ranges.repartition(tasks, "path", "start")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, starts = (batch.column(k).to_pylist() for k in (0, 1))
            n = [Ranges(p).quotes(s, s + step) for p, s in zip(paths, starts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["path", "start", "n"])

    counted = ranges.mapInArrow(count, "path string, start long, n long")
    before = F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    known = counted.withColumn("inside", F.coalesce(before, F.lit(0).cast("long")) % 2 == 1).select("path", "start", "inside")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, s, inside in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows = []
                for row in Ranges(p).entries(s, s + step, inside):
                    rows.append((p, *row))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["path", "key", "value"])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["path", "key", "value"])

    return known.repartition(tasks, "path", "start").mapInArrow(read, "path string, key string, value string")


def write_json_objects(df: DataFrame, key: str, value: str, path: str) -> None:
    """(key, value) rows as JSON objects, one a part file. Rows without a key are left out; a null value is null."""
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = "{"
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([last])], ["value"]) if last == "{" else pa.RecordBatch.from_arrays([pa.array([last + ","])], ["value"])
                last = f" {json.dumps(k, ensure_ascii=False)}: {json.dumps(v, ensure_ascii=False)}"
        yield pa.RecordBatch.from_arrays([pa.array([last] if last == "{" else [last])], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["}"])], ["value"])

    df.where(F.col(key).isNotNull()).select(F.col(key).cast("string"), F.col(value).cast("string")).mapInArrow(lines, "value string").write.mode("overwrite").text(path)
