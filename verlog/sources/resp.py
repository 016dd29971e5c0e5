"""Request files of the wire protocol: arrays of binary-safe strings, one after the other, or lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

#: How much a request may hold.
MAX_ARGUMENTS, MAX_BULK, MAX_LINE = 1024, 8 << 20, 1 << 20
SCHEMA = "file string, nth long, args array<string>, fault string"


def _line(data: bytes, at: int) -> tuple[bytes, int] | None:
    end = data.find(b"\r\n", at)
    return None if end < 0 else (data[at:end], end + 2)


def _length(text: bytes) -> int:
    return int(text) if re.fullmatch(rb"[0-9]{1,18}", text) else -1


def decode(data: bytes) -> Iterator[tuple[list[bytes] | None, str | None]]:
    """(arguments, None) of each whole request; a malformed one gives (None, reason) and ends; one that
    is cut off at the end is left out."""
    at = 0
    while at < len(data):
        if data[at : at + 1] != b"*":
            end = data.find(b"\n", at)
            if end < 0:
                return
            if end - at > MAX_LINE:
                yield None, "line is too large"
                return
            yield data[at:end].removesuffix(b"\r").split(), None
            at = end + 1
            continue
        got = _line(data, at + 1)
        if got is None:
            return
        n, at = _length(got[0]), got[1]
        if n < 0 or n > MAX_ARGUMENTS:
            yield None, "invalid RESP array length" if n < 0 else "too many RESP arguments"
            return
        args: list[bytes] = []
        for _ in range(n):
            if at >= len(data):
                return
            if data[at : at + 1] != b"$":
                yield None, "expected RESP bulk string"
                return
            got = _line(data, at + 1)
            if got is None:
                return
            size, at = _length(got[0]), got[1]
            if size < 0 or size > MAX_BULK:
                yield None, "invalid RESP bulk string length" if size < 0 else "RESP bulk string is too large"
                return
            if at + size + 2 > len(data):
                return
            if data[at + size : at + size + 2] != b"\r\n":
                yield None, "bulk string missing CRLF terminator"
                return
            args.append(data[at : at + size])
            at += size + 2
        yield args, None


def encode(args: list[bytes]) -> bytes:
    return b"*%d\r\n" % len(args) + b"".join(b"$%d\r\n%s\r\n" % (len(a), a) for a in args)


def write(requests: DataFrame, folder: str) -> DataFrame:
    """Write requests(pos, args) as files in the order of pos, one for each range of positions; (file, requests) of each. A
    file appears complete or not at all, and is the same when its task runs again."""
    from pyspark import TaskContext

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        context, n = TaskContext.get(), 0
        name, part = f"{context.partitionId():06d}.resp", f"{at}/.{context.partitionId():06d}-{context.taskAttemptId()}"
        with fs.open_output_stream(part) as out:
            for batch in batches:
                for args in batch.column("args").to_pylist():
                    out.write(encode([a.encode() for a in args]))
                    n += 1
        fs.move(part, f"{at}/{name}")
        yield pa.RecordBatch.from_pydict({"file": pa.array([name]), "requests": pa.array([n], pa.int64())})

    return requests.select("pos", "args").repartitionByRange("pos").sortWithinPartitions("pos").mapInArrow(task, "file string, requests long")


def read(spark: SparkSession, path: str, pattern: str = "*.resp") -> DataFrame:
    """The requests of all files under path in order; bytes that are no UTF-8 are replaced."""
    kind = pa.schema([("file", pa.string()), ("nth", pa.int64()), ("args", pa.list_(pa.string())), ("fault", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(name, n, None if args is None else [a.decode("utf-8", "replace") for a in args], fault) for n, (args, fault) in enumerate(decode(content.as_py()))]
                for k in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 4096], strict=True), kind, strict=True)], schema=kind)

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content").mapInArrow(task, SCHEMA)
