"""The binary manifest: records that add and remove files.

Little endian. An add is `tag u8 | number u64 | max_seq u64 | path length u32 | path | level u32 | bytes u64 |
smallest length u32 | largest length u32 | smallest | largest | crc32 u32`, a removal `tag u8 | number u64 |
crc32 u32`, the checksum over all before it. Older tags are the same without the checksum, and adds once more without
all that follows the path. A file that ends inside a record ends before it; any other fault comes back as a row
with its reason and ends the file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The tags, and how long paths and keys may be.
ADD_PLAIN, REMOVE_PLAIN, ADD_NO_CRC, ADD, REMOVE = 1, 2, 3, 4, 5
MAX_PATH, MAX_KEY = 4096, 64 << 20
HEAD, META = struct.Struct("<QQI"), struct.Struct("<IQII")
SCHEMA = "file string, pos long, action string, file_number long, max_seq long, path string, level int, bytes long, smallest binary, largest binary, fault string"


def add(number: int, max_seq: int, path: str, level: int = 0, size: int = 0, smallest: bytes = b"", largest: bytes = b"") -> bytes:
    name = path.encode()
    if number < 1 or not name or len(name) > MAX_PATH or bool(smallest) != bool(largest) or smallest > largest or max(len(smallest), len(largest)) > MAX_KEY:
        raise ValueError("invalid file")
    body = bytes([ADD]) + HEAD.pack(number, max_seq, len(name)) + name + META.pack(level, size, len(smallest), len(largest)) + smallest + largest
    return body + struct.pack("<I", zlib.crc32(body))


def remove(number: int) -> bytes:
    if number < 1:
        raise ValueError("invalid file")
    body = bytes([REMOVE]) + struct.pack("<Q", number)
    return body + struct.pack("<I", zlib.crc32(body))


def decode(data: bytes) -> Iterator[tuple]:
    """(action, number, max_seq, path, level, bytes, smallest, largest, fault) of a manifest's records."""
    at = 0

    def bad(reason: str) -> tuple:
        return (None,) * 8 + (f"record at {at}: {reason}",)

    while at < len(data):
        tag, end = data[at], at + 1
        level = size = 0
        smallest = largest = b""
        if tag in (ADD_PLAIN, ADD_NO_CRC, ADD):
            if end + HEAD.size > len(data):
                return
            number, max_seq, n = HEAD.unpack_from(data, end)
            if not 0 < n <= MAX_PATH:
                yield bad("path")
                return
            end += HEAD.size + n
            if end > len(data):
                return
            path = data[end - n : end].decode("utf-8", "replace")
            if tag != ADD_PLAIN:
                if end + META.size > len(data):
                    return
                level, size, a, b = META.unpack_from(data, end)
                if max(a, b) > MAX_KEY or (a == 0) != (b == 0):
                    yield bad("key range")
                    return
                end += META.size + a + b
                if end > len(data):
                    return
                smallest, largest = data[end - a - b : end - b], data[end - b : end] if b else b""
            if not number or smallest > largest:
                yield bad("metadata")
                return
            found = ("add", number, max_seq, path, level, size, smallest, largest, None)
        elif tag in (REMOVE_PLAIN, REMOVE):
            if end + 8 > len(data):
                return
            found = ("remove", int.from_bytes(data[end : end + 8], "little"), None, None, None, None, None, None, None)
            end += 8
        else:
            yield bad("unknown tag")
            return
        if tag in (ADD, REMOVE):
            if end + 4 > len(data):
                return
            if int.from_bytes(data[end : end + 4], "little") != zlib.crc32(data[at:end]):
                yield bad("checksum")
                return
            end += 4
        yield found
        at = end


def read(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The records of the manifests under path, in order by pos; live ones by storage.live_files()."""
    names = [p.strip().split(" ")[0] for p in SCHEMA.split(",")]
    kind = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[p.strip().split(" ")[1]]) for n, p in zip(names, SCHEMA.split(","), strict=True)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(name, k, *r) for k, r in enumerate(decode(content.as_py()))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content").mapInArrow(task, SCHEMA)


def write(spark: SparkSession, records: DataFrame, path: str) -> None:
    """Write records(pos, action, file_number, max_seq, path, level, bytes, smallest, largest) as one manifest. It has a record
    for each change of files, so the driver writes it, a record at a time."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    try:
        for r in records.orderBy("pos").toLocalIterator():
            out.write(bytearray(remove(r.file_number) if r.action == "remove" else add(r.file_number, r.max_seq, r.path, r.level, r.bytes, bytes(r.smallest), bytes(r.largest))))
    finally:
        out.close()
