"""Hashes: a key's fields, each with its newest value; a key without fields is gone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fields(ops: DataFrame) -> DataFrame:
    """key, field, value of the live fields after ops(key, pos, op, field, value), op HSET or HDEL."""
    last = ops.groupBy("key", "field").agg(F.max_by(F.struct("op", "value"), "pos").alias("v"))
    return last.where("v.op = 'HSET'").select("key", "field", "v.value")


def hgetall(ops: DataFrame) -> DataFrame:
    """Each key's fields in byte order, as a sorted array of (field, value)."""
    return fields(ops).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("field", "value"))).alias("items"))


def hkeys(whole: DataFrame) -> DataFrame:
    return whole.select("key", F.transform("items", lambda x: x["field"]).alias("fields"))


def hvals(whole: DataFrame) -> DataFrame:
    """Values in the order of their fields."""
    return whole.select("key", F.transform("items", lambda x: x["value"]).alias("values"))


def hlen(ops: DataFrame) -> DataFrame:
    return fields(ops).groupBy("key").agg(F.count("*").alias("n"))


def hget(ops: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(pos, key, field) with the value or null, and whether the field is there."""
    found = requests.join(fields(ops).withColumn("present", F.lit(True)), ["key", "field"], "left")
    return found.select("pos", "key", "field", "value", F.coalesce("present", F.lit(False)).alias("present"))


def replies(ops: DataFrame) -> DataFrame:
    """What each operation returns: HSET 1 for a new field and 0 for one that was there, HDEL the reverse."""
    before = F.lag("op").over(Window.partitionBy("key", "field").orderBy("pos"))
    there = F.coalesce(before == "HSET", F.lit(False))
    return ops.select("key", "pos", "op", "field", F.when(F.col("op") == "HSET", ~there).otherwise(there).cast("int").alias("reply"))


def emptied(ops: DataFrame) -> DataFrame:
    """Keys that had a field once and have none now."""
    touched = ops.where("op = 'HSET'").select("key").distinct()
    return touched.join(fields(ops).select("key").distinct(), "key", "left_anti")
