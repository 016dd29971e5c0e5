"""Reads of a change log: which version of a key is visible, and what follows from it.

Only predicates on key and seq may come before the choice of version: the newest version decides
even when it is a tombstone or has expired, so an older one never comes back. `latest` keeps one row
for each key and task before its only shuffle, so keys with very many versions are no hot spots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import keep


def latest(log: DataFrame, upto: int | None = None) -> DataFrame:
    """The newest version of each key, dead or not, among those up to a sequence number."""
    seen = log if upto is None else log.where(F.col("seq") <= upto)
    newest = seen.groupBy("key").agg(F.max_by(F.struct("seq", "type", "value", "expires_at_ms"), "seq").alias("v"))
    return newest.select("key", "v.seq", "v.type", "v.value", "v.expires_at_ms")


def expired(now_ms: int) -> Column:
    """Inclusive: a value is gone in the millisecond of its expiry."""
    return (F.col("expires_at_ms") != 0) & (F.col("expires_at_ms") <= now_ms)


def live(log: DataFrame, now_ms: int, upto: int | None = None) -> DataFrame:
    return latest(log, upto).where((F.col("type") == 0) & ~expired(now_ms))


def in_range(start: str = "", end: str = "") -> Column:
    """From start on, before end; an empty end has no bound."""
    from_start = F.col("key") >= F.lit(start)
    return from_start & (F.col("key") < F.lit(end)) if end else from_start


def get(log: DataFrame, key: str, now_ms: int, upto: int | None = None) -> DataFrame:
    if not key:
        raise ValueError("empty key")
    return live(log.where(F.col("key") == key), now_ms, upto)


def mget(log: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """requests(pos, key) with the live value or null, duplicates kept."""
    asked = log.join(requests.select("key").distinct(), "key", "left_semi")
    return requests.join(live(asked, now_ms).select("key", "value"), "key", "left").select("pos", "key", "value")


def exists(log: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    found = mget(log, requests, now_ms)
    return found.select("pos", "key", F.col("value").isNotNull().alias("present"))


def scan(log: DataFrame, now_ms: int, start: str = "", end: str = "", limit: int = 0, upto: int | None = None) -> DataFrame:
    """Live pairs of a key range in key order; limit 0 is none."""
    ordered = live(log.where(in_range(start, end)), now_ms, upto).select("key", "value").orderBy("key")
    return ordered.limit(limit) if limit else ordered


def scan_reply(pairs: DataFrame) -> DataFrame:
    """The flat reply of a scan: each pair as two items (key, item 0 or 1, text)."""
    return pairs.select("key", F.posexplode(F.array("key", "value")).alias("item", "text"))


def prefix(log: DataFrame, start: str, now_ms: int) -> DataFrame:
    return live(log.where(F.col("key").startswith(start)), now_ms).select("key", "value")


def seek(log: DataFrame, target: str, now_ms: int) -> DataFrame:
    """The first live pair at or after target."""
    return scan(log, now_ms, start=target, limit=1)


def next_keys(pairs: DataFrame) -> DataFrame:
    """Each key of a frame of distinct keys with the one after it, null for the last: keys are range-partitioned, and
    only the first key of each partition meets the last one of the partition before it."""
    placed = keep(pairs.select("key").repartitionByRange("key").withColumn("part", F.spark_partition_id()), "keys")
    firsts = placed.groupBy("part").agg(F.min("key").alias("first"))
    following = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("following"))  # a row for each partition
    within = placed.withColumn("next_key", F.lead("key").over(Window.partitionBy("part").orderBy("key")))
    return within.join(F.broadcast(following), "part").select("key", F.coalesce("next_key", "following").alias("next_key"))


def versions(log: DataFrame) -> DataFrame:
    """All versions in table order: key, then newest first, then type."""
    return log.orderBy("key", F.desc("seq"), "type")


def pttl(log: DataFrame, requests: DataFrame, now_ms: int, upto: int | None = None) -> DataFrame:
    """Milliseconds left and whole seconds left for requests(pos, key); -2 is missing, -1 without expiry."""
    asked = log.join(requests.select("key").distinct(), "key", "left_semi")
    left = requests.join(live(asked, now_ms, upto).select("key", "seq", "expires_at_ms"), "key", "left")
    ms = F.when(F.col("seq").isNull(), -2).when(F.col("expires_at_ms") == 0, -1).otherwise(F.col("expires_at_ms") - now_ms)
    return left.select("pos", "key", ms.cast("long").alias("pttl_ms")).withColumn(
        "ttl_s", F.when(F.col("pttl_ms") < 0, F.col("pttl_ms")).otherwise(F.floor(F.col("pttl_ms") / 1000)).cast("long")
    )


def expiry_schedule(log: DataFrame) -> DataFrame:
    """The one deadline of each key that has any, in the order they fall due."""
    return latest(log).where("type = 0 and expires_at_ms <> 0").select("key", "expires_at_ms").orderBy("expires_at_ms", "key")


def deadlines(ops: DataFrame, default_ttl_ms: int = 0) -> DataFrame:
    """(key, expires_at_ms) after ops(key, pos, ts_ms, op, ttl_ms), op SET or ERASE: the last one of a key counts. A SET
    with a negative time takes the default; one that comes to 0 erases."""
    last = ops.groupBy("key").agg(F.max_by(F.struct("op", "ttl_ms", "ts_ms"), "pos").alias("v"))
    ttl = F.when(F.col("v.ttl_ms") < 0, default_ttl_ms).otherwise(F.col("v.ttl_ms"))
    return last.where((F.col("v.op") == "SET") & (ttl > 0)).select("key", (F.col("v.ts_ms") + ttl).alias("expires_at_ms"))


def purge(held: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(the deadlines that are due, in key order, and those that stay)."""
    due = F.col("expires_at_ms") <= now_ms
    return held.where(due).orderBy("key"), held.where(~due)


def latest_seq(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.max("seq").alias("seq"))


def snapshot_seq(log: DataFrame) -> int:
    """The horizon that a snapshot taken now has."""
    return log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]


class Snapshots:
    """Which sequence numbers are pinned; a pin is released once."""

    def __init__(self):
        self._held: dict[int, int] = {}
        self._next = 1

    def take(self, log: DataFrame) -> int:
        self._held[self._next] = snapshot_seq(log)
        self._next += 1
        return self._next - 1

    def seq(self, snapshot: int) -> int:
        if snapshot not in self._held:
            raise ValueError("unknown or released snapshot")
        return self._held[snapshot]

    def release(self, snapshot: int) -> None:
        self.seq(snapshot)
        del self._held[snapshot]

    @property
    def active(self) -> int:
        return len(self._held)
