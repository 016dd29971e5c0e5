"""The stored bytes of hashes, lists and values with an expiry, and of replicated commands: encoders as columns, decoders
for Arrow batches and, for commands, as columns.

A list is `count u32 | (length u32 | bytes)…`, a hash the same with a field and a value for each, in byte order of the
fields, all little endian; a value with an expiry is a mark, the expiry as u64 and the value. A command is a letter, a length
and the key, then by letter a length and the value (S, T) and the expiry (T, E); N has the letter alone, M a count and
members of 8 bytes each; these are big endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many elements an encoding may have, and the mark of a value with an expiry.
MOST_ELEMENTS, MARK = 1 << 20, b"KVTTL001"


def _little(n: Column, size: int) -> Column:
    """The hexadecimal digits of a whole number's bytes, the least first."""
    return F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(n.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(size)))


def _part(text: Column) -> Column:
    return F.concat(_little(F.octet_length(text), 4), F.hex(text.cast("binary")))


def encode_list(items: Column) -> Column:
    """The bytes of array<string>; null of null."""
    return F.unhex(F.concat(_little(F.size(items), 4), F.array_join(F.transform(items, _part), "")))


def encode_hash(pairs: Column) -> Column:
    """The bytes of a sorted array of (field, value) without a field twice."""
    return F.unhex(F.concat(_little(F.size(pairs), 4), F.array_join(F.transform(pairs, lambda p: F.concat(_part(p["field"]), _part(p["value"].cast("string")))), "")))


def encode_value(value: Column, expires_at_ms: Column) -> Column:
    plain = value.cast("binary")
    return F.when(expires_at_ms == 0, plain).otherwise(F.unhex(F.concat(F.lit(MARK.hex()), _little(expires_at_ms, 8), F.hex(plain))))


def decode_value(data: Column) -> tuple[Column, Column]:
    """(value as bytes, expiry); bytes without the mark, or with expiry 0, are a plain value."""
    digits = F.hex(F.substring(data, len(MARK) + 1, 8))
    expiry = sum((F.conv(F.substring(digits, 2 * k + 1, 2), 16, 10).cast("long") * F.lit(1 << 8 * k) for k in range(7)), F.lit(0).cast("long"))
    marked = (F.substring(data, 1, len(MARK)) == F.lit(MARK)) & (F.length(data) >= len(MARK) + 8) & (expiry > 0)
    return F.when(marked, F.substr(data, F.lit(len(MARK) + 9))).otherwise(data), F.when(marked, expiry).otherwise(F.lit(0).cast("long"))


def _big(n: Column, size: int) -> Column:
    return F.lpad(F.hex(n.cast("long")), 2 * size, "0")


def encode_command(op: Column, key: Column, value: Column, expires_at_ms: Column, members: Column | None = None) -> Column:
    """The bytes of a command by its letter; null of another letter."""
    sized = lambda c: F.concat(_big(F.octet_length(c), 4), F.hex(c.cast("binary")))
    body = F.when(op == "S", F.concat(sized(key), sized(value))).when(op == "T", F.concat(sized(key), sized(value), _big(expires_at_ms, 8))).when(op == "E", F.concat(sized(key), _big(expires_at_ms, 8)))
    body = body.when(op == "D", sized(key)).when(op == "N", F.lit(""))
    if members is not None:
        body = body.when(op == "M", F.concat(_big(F.size(members), 4), F.array_join(F.transform(members, lambda m: _big(m, 8)), "")))
    return F.unhex(F.concat(F.hex(op.cast("binary")), body))


def decode_command(data: Column) -> Column:
    """struct(op, key, value, expires_at_ms), or null of bytes that are no whole command of letter S, T, E, D or N."""
    number = lambda at, size: F.conv(F.hex(F.substr(data, at.cast("int"), F.lit(size))), 16, 10).cast("long")
    op, n = F.substr(data, F.lit(1), F.lit(1)).cast("string"), F.length(data)
    n_key = number(F.lit(2), 4)
    after = n_key + 6  # the place after the key
    n_value = F.when(op.isin("S", "T") & (n >= after + 3), number(after, 4))
    ends = F.when(op == "N", 1).when(n < 5, None).when(op == "D", after - 1).when(op == "E", after + 7).when(op == "S", after + 3 + n_value).when(op == "T", after + 11 + n_value)
    expiry = F.when(op == "E", number(after, 8)).when(op == "T", number(after + 4 + n_value, 8)).otherwise(F.lit(0).cast("long"))
    key = F.when(op == "N", F.lit("")).otherwise(F.substr(data, F.lit(6), n_key.cast("int")).cast("string"))
    value = F.when(op.isin("S", "T"), F.substr(data, (after + 4).cast("int"), n_value.cast("int")).cast("string")).otherwise(F.lit(""))
    return F.when(n == ends, F.struct(op.alias("op"), key.alias("key"), value.alias("value"), expiry.alias("expires_at_ms")))


def decode_parts(data: bytes, each: int = 1) -> list[bytes] | None:
    """The elements of an encoded list (each 1), or fields and values of a hash in turn (each 2); null if it is damaged."""
    if len(data) < 4:
        return None
    (count,) = struct.unpack_from("<I", data)
    if count > MOST_ELEMENTS or count > (len(data) - 4) // (4 * each):
        return None
    out, at = [], 4
    for _ in range(count * each):
        if at + 4 > len(data):
            return None
        (size,) = struct.unpack_from("<I", data, at)
        at += 4 + size
        if at > len(data):
            return None
        out.append(data[at - size : at])
    return out if at == len(data) else None


def decode_hash(data: bytes) -> dict[bytes, bytes] | None:
    """Of a field that is there twice the last counts."""
    parts = decode_parts(data, 2)
    return None if parts is None else dict(zip(parts[::2], parts[1::2], strict=True))


def decode_column(df: DataFrame, column: str, hashes: bool = False) -> DataFrame:
    """df with `items` (array<string>; fields and values in turn for hashes, in byte order) in place of the encoding; null where it is
    damaged. Bytes that are no UTF-8 are replaced."""
    kept = [(c, t) for c, t in df.dtypes if c not in (column, "items")]

    def items(data: bytes | None) -> list[str] | None:
        if data is None:
            return None
        if hashes:
            found = decode_hash(data)
            parts = None if found is None else [x for f in sorted(found) for x in (f, found[f])]
        else:
            parts = decode_parts(data)
        return None if parts is None else [p.decode("utf-8", "replace") for p in parts]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c, _ in kept), pa.array([items(v) for v in part.column(column).to_pylist()], pa.list_(pa.string()))], names=[*(c for c, _ in kept), "items"])

    return df.mapInArrow(task, "".join(f"`{c}` {t}, " for c, t in kept) + "items array<string>")
