"""The binary log format: records of crc32, type, sequence, lengths, key and value.

A record is `crc32 u32 | type u8 | seq u64 | key length u32 | value length u32 | key | value`, little
endian, the checksum over all that follows it; a value with a time to live starts with its expiry as
u64 and counts that in its length. A file that ends inside a record ends before it; any other fault
stops the file and comes back as a row with its reason.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from ..config import Options

PUT, DELETE, PUT_TTL = 0, 1, 2
HEAD = struct.Struct("<IBQII")
MOST = 64 << 20
SCHEMA = "file string, key binary, seq long, type int, value binary, expires_at_ms long, fault string"


def encode(key: bytes, seq: int, kind: int, value: bytes | None, expires_at_ms: int = 0) -> bytes:
    """One record of a log row (type 0 or 1)."""
    if seq < 1:
        raise ValueError("sequence below 1")
    if kind == DELETE and (value or expires_at_ms):
        raise ValueError("deletion with a value or an expiry")
    body = b"" if value is None else value
    code = PUT_TTL if expires_at_ms else kind
    if code == PUT_TTL:
        body = struct.pack("<Q", expires_at_ms) + body
    if len(key) + len(body) > MOST:
        raise ValueError("record too large")
    rest = HEAD.pack(0, code, seq, len(key), len(body))[4:] + key + body
    return struct.pack("<I", zlib.crc32(rest)) + rest


def decode(data: bytes) -> Iterator[tuple]:
    """(key, seq, type, value, expiry, fault) of a file's records."""
    at = 0
    while at + HEAD.size <= len(data):
        crc, code, seq, n_key, n_value = HEAD.unpack_from(data, at)
        if n_key + n_value > MOST:
            yield None, None, None, None, None, f"record at {at} too large"
            return
        end = at + HEAD.size + n_key + n_value
        if end > len(data):
            return
        key, value = data[at + HEAD.size : end - n_value], data[end - n_value : end]
        fault, expires = None, 0
        if zlib.crc32(memoryview(data)[at + 4 : end]) != crc:
            fault = "checksum"
        elif code not in (PUT, DELETE, PUT_TTL):
            fault = "unknown type"
        elif not seq:
            fault = "sequence 0"
        elif code == DELETE and value:
            fault = "deletion with a value"
        elif code == PUT_TTL and (len(value) < 8 or not any(value[:8])):
            fault = "no expiry"
        if fault:
            yield None, None, None, None, None, f"record at {at}: {fault}"
            return
        if code == PUT_TTL:
            expires, value = int.from_bytes(value[:8], "little"), value[8:]
        yield key, seq, DELETE if code == DELETE else PUT, None if code == DELETE else value, expires, None
        at = end


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The records of all .wal files under path; strict fails on the first fault when it is read."""
    kind = pa.schema([("file", pa.string()), ("key", pa.binary()), ("seq", pa.int64()), ("type", pa.int32()), ("value", pa.binary()), ("expires_at_ms", pa.int64()), ("fault", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                for r in decode(content.as_py()):
                    if r[5] and strict:
                        raise ValueError(f"{name}: {r[5]}")
                    rows.append((name, *r))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").load(path).select("path", "content").mapInArrow(task, SCHEMA)


def write_segments(log: DataFrame, folder: str, segment_bytes: int = Options.wal_segment_size_bytes) -> DataFrame:
    """Write log rows in sequence order as segments of about segment_bytes; (file, records) of each.

    Ranges of sequence numbers are written in parallel. A segment is named by its first number with 20
    digits, appears complete or not at all, and is the same when its task runs again.
    """
    from pyspark import TaskContext

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        held: list[bytes] = []
        first = size = 0

        def close() -> pa.RecordBatch:
            name, part = f"{at}/{first:020d}.wal", f"{at}/.{first:020d}-{TaskContext.get().taskAttemptId()}"
            with fs.open_output_stream(part) as out:
                for r in held:
                    out.write(r)
            fs.move(part, name)
            return pa.RecordBatch.from_pydict({"file": pa.array([f"{first:020d}.wal"]), "records": pa.array([len(held)], pa.int64())})

        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                for r in batch.slice(k, 4096).to_pylist():
                    first = first if held else r["seq"]
                    held.append(encode(r["key"].encode(), r["seq"], r["type"], None if r["value"] is None else r["value"].encode(), r["expires_at_ms"]))
                    size += len(held[-1])
                    if size >= segment_bytes:
                        yield close()
                        held, size = [], 0
        if held:
            yield close()

    return log.select("key", "seq", "type", "value", "expires_at_ms").repartitionByRange("seq").sortWithinPartitions("seq").mapInArrow(task, "file string, records long")
