"""Adapters from the driver's tables to change logs, operation logs and node tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000
NODES = [("n1", "127.0.0.1", 9001, 1, True), ("n2", "127.0.0.1", 9002, 2, True), ("n3", "127.0.0.1", 9003, 1, True), ("n4", "127.0.0.1", 9004, 1, False)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: str) -> F.Column:
    """Whole milliseconds since 1970 of a zone-less timestamp, whatever the session's time zone is."""
    return F.expr(
        f"unix_date(cast({ts} as date)) * 86400000L + hour({ts}) * 3600000L + minute({ts}) * 60000L + cast(floor(extract(second from {ts}) * 1000) as bigint)"
    )


def _log(df: DataFrame, key, seq, kind, value, expires) -> DataFrame:
    return df.select(key.alias("key"), seq.alias("seq"), kind.cast("int").alias("type"), value.alias("value"), expires.cast("long").alias("expires_at_ms"))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    dead = F.col("event_type") == "error"
    return _log(
        table(spark, sf_dir, "events"), F.concat(F.lit("user:"), "user_id"), F.col("event_id") + 1, F.when(dead, 1).otherwise(0),
        F.when(~dead, F.col("event_type")), F.when(F.col("event_type") == "view", epoch_ms("ts") + DAY_MS).otherwise(0),
    )


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    dead = F.col("o_orderstatus") == "F"
    return _log(
        table(spark, sf_dir, "orders"), F.concat(F.lit("cust:"), "o_custkey"), F.col("o_orderkey") + 1, F.when(dead, 1).otherwise(0),
        F.when(~dead, F.col("o_orderpriority")), F.lit(0),
    )


def hash_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, pos (an order: a struct), op, field, value."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("order:"), "l_orderkey").alias("key"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("pos"),
        F.when(F.col("l_returnflag") == "R", "HDEL").otherwise("HSET").alias("op"), F.concat(F.lit("p"), "l_partkey").alias("field"),
        F.col("l_quantity").cast("long").alias("value"),
    )


def _event_ops(spark: SparkSession, sf_dir: str, ops: dict[str, tuple[str, F.Column]]) -> DataFrame:
    op, arg = F.lit(None).cast("string"), F.lit(None).cast("long")
    for kind, (name, value) in ops.items():
        op = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(op)
        arg = F.when(F.col("event_type") == kind, value.cast("long")).otherwise(arg)
    df = table(spark, sf_dir, "events")
    return df.select(F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_id").alias("pos"), op.alias("op"), arg.alias("n")).where("op is not null")


def counter_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, none = F.lit(1), F.lit(None)
    return _event_ops(spark, sf_dir, {"purchase": ("INCRBY", one), "click": ("DECRBY", one), "signup": ("SET", F.lit(10)), "error": ("DEL", none)})


def list_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, none = F.col("event_id"), F.lit(None)
    return _event_ops(spark, sf_dir, {"purchase": ("LPOP", none), "click": ("RPUSH", own), "error": ("RPOP", none), "view": ("LPUSH", own)})


def claim_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_id").alias("pos"), epoch_ms("ts").alias("ts_ms"), F.lit(DAY_MS).cast("long").alias("ttl_ms"),
        F.col("event_type").alias("value"),
    )


def txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """txn, start_seq, key, pos: one key that is read and written."""
    return table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 1).alias("txn"), F.greatest(F.col("o_orderkey") + 1 - 50, F.lit(0)).alias("start_seq"),
        F.concat(F.lit("cust:"), "o_custkey").alias("key"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("value"),
    )


def nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NODES, "id string, host string, port int, weight int, alive boolean")
