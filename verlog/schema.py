"""Schemas of change logs and command logs, and the rules their rows obey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE, DELETION = 0, 1
MAX_INT64, MIN_INT64 = 2**63 - 1, -(2**63)

#: The change log: seq is unique and at least 1; a deletion has no value and no expiry; expiry 0 is none.
LOG = T.StructType([
    T.StructField("key", T.StringType(), False), T.StructField("seq", T.LongType(), False), T.StructField("type", T.IntegerType(), False),
    T.StructField("value", T.StringType()), T.StructField("expires_at_ms", T.LongType(), False),
])


def fault(key: str = "key", seq: str = "seq", kind: str = "type", value: str = "value", expires: str = "expires_at_ms") -> Column:
    """What is wrong with a log row, or null."""
    return (
        F.when(F.coalesce(F.octet_length(key), F.lit(0)) == 0, "empty key")
        .when(F.col(seq).isNull() | (F.col(seq) < 1), "sequence below 1")
        .when(~F.col(kind).isin(VALUE, DELETION), "unknown type")
        .when((F.col(kind) == DELETION) & F.col(value).isNotNull(), "deletion with a value")
        .when((F.col(kind) == DELETION) & (F.col(expires) != 0), "deletion with an expiry")
    )


def split_faulty(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sound rows, faulty rows with a reason)."""
    marked = log.withColumn("reason", fault())
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def duration_ms(ttl_ms: int) -> int:
    """A time to live in ms: 0 is none; a negative one is an error."""
    if ttl_ms < 0:
        raise ValueError("negative time to live")
    return ttl_ms


def seconds_to_ms(seconds: int) -> int:
    if abs(seconds) > MAX_INT64 // 1000:
        raise ValueError("time to live out of range")
    return seconds * 1000
