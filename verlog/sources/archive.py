"""Archives of a snapshot's files: a mark, the number of files, and for each its path and content.

Big endian: `mark | files u32 | (path length u32 | content length u64 | path | content)…`. A path that leads out of the
folder, a cut entry and bytes after the last one make the whole archive invalid.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Fixed value: how an archive begins.
MARK = b"KVRAFTSNAP1"
HEAD = struct.Struct(">IQ")


def safe(path: str) -> bool:
    """Whether a path stays within its folder."""
    p = PurePosixPath(path)
    return bool(path) and not p.is_absolute() and ".." not in p.parts and p.parts != ()


def pack(files: Iterable[tuple[str, bytes]]) -> bytes:
    out = []
    for path, content in files:
        if not safe(path):
            raise ValueError(f"unsafe path: {path}")
        name = path.encode()
        out.append(HEAD.pack(len(name), len(content)) + name + content)
    return MARK + struct.pack(">I", len(out)) + b"".join(out)


def unpack(data: bytes) -> list[tuple[str, bytes]]:
    if data[: len(MARK)] != MARK or len(data) < len(MARK) + 4:
        raise ValueError("no archive")
    (count,) = struct.unpack_from(">I", data, len(MARK))
    at, out = len(MARK) + 4, []
    for _ in range(count):
        if at + HEAD.size > len(data):
            raise ValueError("cut header")
        n, size = HEAD.unpack_from(data, at)
        at += HEAD.size
        if not n or n + size > len(data) - at:
            raise ValueError("invalid entry")
        path = data[at : at + n].decode("utf-8", "surrogateescape")
        if not safe(path):
            raise ValueError("unsafe path")
        out.append((path, data[at + n : at + n + size]))
        at += n + size
    if at != len(data):
        raise ValueError("bytes after the last entry")
    return out


def read(spark: SparkSession, path: str, pattern: str = "*.snap") -> DataFrame:
    """(archive, path, content, fault) of the files in all archives under path; an invalid one is a row with its reason."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = [(name, p, c, None) for p, c in unpack(content.as_py())]
                except ValueError as e:
                    rows = [(name, None, None, str(e))]
                for row in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.string(), pa.binary(), pa.string()), strict=True)], names=["archive", "path", "content", "fault"])

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content").mapInArrow(task, "archive string, path string, content binary, fault string")
