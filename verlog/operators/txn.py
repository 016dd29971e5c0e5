"""Optimistic transactions: what they read, what they write, which of them conflict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import stream_fold
from .visible import latest_seq


def as_of(log: DataFrame, reads: DataFrame) -> DataFrame:
    """reads(txn, key, start_seq) with the newest version up to start_seq.

    Versions and reads of a key are merged in sequence order and each read takes the last version
    before it: linear in both, where a join on key would pair every read with every version.
    """
    versions = log.select("key", "seq", F.lit(0).alias("k"), F.lit(None).cast("long").alias("txn"), F.struct("seq", "type", "value", "expires_at_ms").alias("v"))
    asks = reads.select("key", F.col("start_seq").alias("seq"), F.lit(1).alias("k"), "txn", F.lit(None).cast(versions.schema["v"].dataType).alias("v"))
    before = Window.partitionBy("key").orderBy("seq", "k").rowsBetween(Window.unboundedPreceding, 0)
    merged = versions.unionByName(asks).withColumn("v", F.last("v", ignorenulls=True).over(before)).where("k = 1")
    return merged.select("txn", "key", F.col("seq").alias("start_seq"), "v.type", "v.value", "v.expires_at_ms", F.col("v.seq").alias("seq"))


def dedupe_writes(writes: DataFrame) -> DataFrame:
    """writes(txn, pos, op, key, value): the last write of each key, at the place of the first."""
    last = writes.groupBy("txn", "key").agg(F.max_by(F.struct("op", "value"), "pos").alias("w"), F.min("pos").alias("pos"))
    return last.select("txn", "pos", "key", "w.op", "w.value")


def read(log: DataFrame, reads: DataFrame, writes: DataFrame, now_ms: int) -> DataFrame:
    """What each of reads(txn, key, start_seq) sees: its own write first (tracked false), else the log as
    of start_seq, and then the key joins the read set, found or not."""
    own = dedupe_writes(writes).select("txn", "key", F.col("op").alias("own_op"), F.col("value").alias("own_value"))
    seen = as_of(log, reads).join(own, ["txn", "key"], "left")
    is_own = F.col("own_op").isNotNull()
    visible = (F.col("type") == 0) & ((F.col("expires_at_ms") == 0) | (F.col("expires_at_ms") > now_ms))
    value = F.when(is_own, F.when(F.col("own_op") == "PUT", F.col("own_value"))).when(visible, F.col("value"))
    return seen.select("txn", "key", value.alias("value"), (~is_own).alias("tracked"))


def conflicts(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Of keys(txn, start_seq, key), the union of read and write sets: whether some key has a version
    after start_seq. Validates against one fixed log; see schedule() for one that the outcomes change."""
    found = keys.distinct().join(latest_seq(log), "key", "left")
    return found.groupBy("txn").agg(F.coalesce(F.max(F.col("seq") > F.col("start_seq")), F.lit(False)).alias("conflict"))


def schedule(commits: DataFrame) -> DataFrame:
    """Replay of commits(part, pos, txn, start_seq, keys): each is validated against the commits before
    it that succeeded; its versions are numbered pos + 1. part keeps apart what shares no key."""

    def begin():
        last: dict[str, int] = {}

        def step(row):
            if row is None:
                return []
            conflict = any(last.get(k, 0) > row["start_seq"] for k in row["keys"])
            if not conflict:
                last.update(dict.fromkeys(row["keys"], row["pos"] + 1))
            return [(row["txn"], not conflict)]

        return step

    return stream_fold(commits, "part", ["pos"], begin, "txn long, committed boolean")


def pessimistic(ops: DataFrame) -> DataFrame:
    """Replay of ops(part, pos, txn, op, key, value), op GET, PUT, DEL, COMMIT or ROLLBACK, where a write
    locks its key until the end of its transaction and reads see what is committed, or own writes.
    Replies: OK, the value, or null; a locked key gives 'write conflict'."""

    def begin():
        store: dict[str, str] = {}
        held: dict[str, int] = {}
        staged: dict[int, dict[str, str | None]] = {}

        def step(row):
            if row is None:
                return []
            txn, op, key = row["txn"], row["op"], row["key"]
            own = staged.setdefault(txn, {})
            if op == "GET":
                return [(row["pos"], txn, own[key] if key in own else store.get(key), None)]
            if op in ("COMMIT", "ROLLBACK"):
                if op == "COMMIT":
                    for k, v in own.items():
                        store.pop(k, None) if v is None else store.update({k: v})
                for k in [k for k, t in held.items() if t == txn]:
                    del held[k]
                staged.pop(txn)
                return [(row["pos"], txn, "OK", None)]
            if held.setdefault(key, txn) != txn:
                return [(row["pos"], txn, None, "write conflict")]
            own[key] = row["value"] if op == "PUT" else None
            return [(row["pos"], txn, "OK", None)]

        return step

    return stream_fold(ops, "part", ["pos"], begin, "pos long, txn long, reply string, error string")


def locks(trace: DataFrame) -> DataFrame:
    """Replay of trace(key, pos, owner, op), op S, X or UNLOCK: granted or not. A sole reader may upgrade;
    the holder of X may take S. Owner 0 and empty keys get nothing."""

    def begin():
        readers: set[int] = set()
        state = {"writer": 0}

        def step(row):
            if row is None:
                return []
            who, op = row["owner"], row["op"]
            if not who or not row["key"]:
                granted = False
            elif op == "UNLOCK":
                granted = who in readers or state["writer"] == who
                readers.discard(who)
                state["writer"] = 0 if state["writer"] == who else state["writer"]
            elif op == "S":
                granted = state["writer"] in (0, who)
                if granted and state["writer"] != who:
                    readers.add(who)
            else:
                granted = state["writer"] == who or (not state["writer"] and readers <= {who})
                if granted:
                    readers.discard(who)
                    state["writer"] = who
            return [(row["key"], row["pos"], granted)]

        return step

    return stream_fold(trace, "key", ["pos"], begin, "key string, pos long, granted boolean")
