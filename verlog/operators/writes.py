"""Writes: each is a frame of new log rows; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DELETION, VALUE, duration_ms
from .visible import live

RANGES = 1 << 13


def number(df: DataFrame, pos: str = "pos", start: int = 1, name: str = "seq") -> DataFrame:
    """Consecutive numbers in the order of a whole-number column, without a global sort: RANGES equal ranges of
    positions are counted, and only those counts are summed up in one place."""
    ends = df.agg(F.min(pos).alias("__lo"), F.greatest(F.lit(1).cast("long"), F.ceil((F.max(pos) - F.min(pos) + 1) / RANGES)).alias("__width"))
    ranged = df.crossJoin(F.broadcast(ends)).withColumn("__b", F.floor((F.col(pos) - F.col("__lo")) / F.col("__width"))).drop("__lo", "__width")
    sums = ranged.groupBy("__b").agg(F.count("*").alias("n")).select(
        "__b", (F.coalesce(F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + start - 1).alias("__before")
    )
    nth = F.row_number().over(Window.partitionBy("__b").orderBy(pos))
    return ranged.withColumn("__n", nth).join(sums, "__b").withColumn(name, F.col("__before") + F.col("__n")).drop("__b", "__n", "__before")


def put(spark, key: str, value: str, next_seq: int, ttl_ms: int = 0, now_ms: int = 0) -> DataFrame:
    """A put without a time to live clears one that was there."""
    if not key:
        raise ValueError("empty key")
    expires = now_ms + ttl_ms if duration_ms(ttl_ms) else 0
    return spark.createDataFrame([(key, next_seq, VALUE, value, expires)], "key string, seq long, type int, value string, expires_at_ms long")


def delete(spark, key: str, next_seq: int) -> DataFrame:
    """A tombstone, whether the key is there or not."""
    if not key:
        raise ValueError("empty key")
    return spark.createDataFrame([(key, next_seq, DELETION, None, 0)], "key string, seq long, type int, value string, expires_at_ms long")


def batch(ops: DataFrame, next_seq: int) -> DataFrame:
    """Log rows of ops(pos, op, key, value) with op PUT or DEL, in order. One empty key fails the whole
    batch; puts clear expiries; of duplicates the last wins by its sequence number."""
    whole = ops.withColumn("key", F.when(F.coalesce(F.octet_length("key"), F.lit(0)) > 0, F.col("key")).otherwise(F.raise_error(F.lit("empty key"))))
    kind = F.when(F.col("op") == "DEL", DELETION).otherwise(VALUE)
    return number(whole, "pos", next_seq).select(
        "key", "seq", kind.alias("type"), F.when(kind == VALUE, F.col("value")).alias("value"), F.lit(0).cast("long").alias("expires_at_ms")
    )


def batch_size(ops: DataFrame) -> DataFrame:
    """How many operations, and the bytes they are reckoned at."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 1
    return ops.agg(F.count("*").alias("n_ops"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def put_if_absent(claims: DataFrame) -> DataFrame:
    """The first writer of each key of claims(key, seq, value), where nothing expires or is deleted."""
    first = claims.groupBy("key").agg(F.min_by(F.struct("seq", "value"), "seq").alias("v"))
    return first.select("key", "v.seq", "v.value")


def expire(log: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """requests(pos, key, ttl_ms): reply 1, with the row to append (a new version with the same value
    and the new expiry, or a tombstone where ttl_ms is 0 or less), or reply 0 for a missing key."""
    found = requests.join(live(log.join(requests.select("key").distinct(), "key", "left_semi"), now_ms).select("key", "value"), "key", "left")
    there, dies = F.col("value").isNotNull(), F.col("ttl_ms") <= 0
    return found.select(
        "pos", "key", there.cast("int").alias("reply"), F.when(there, F.when(dies, DELETION).otherwise(VALUE)).alias("type"),
        F.when(there & ~dies, F.col("value")).alias("value"),
        F.when(there, F.when(dies, F.lit(0)).otherwise(F.try_add(F.lit(now_ms), F.col("ttl_ms")))).cast("long").alias("expires_at_ms"),
    )


def persist(log: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """requests(pos, key): reply 1 if the key is live (also if nothing had to change) else 0; writes says
    whether a version without expiry is appended."""
    found = requests.join(live(log.join(requests.select("key").distinct(), "key", "left_semi"), now_ms).select("key", "value", "expires_at_ms"), "key", "left")
    there = F.col("value").isNotNull()
    return found.select("pos", "key", there.cast("int").alias("reply"), F.coalesce(there & (F.col("expires_at_ms") != 0), F.lit(False)).alias("writes"), "value")
