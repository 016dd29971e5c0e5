"""Ordered folds: operations whose outcome depends on the outcomes before them.

A fold streams the rows of each key in order and keeps only the key's state. A key with a third of
all rows is one task's stream, which is inherent, but never a collected list.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import MAX_INT64, MIN_INT64


def stream_fold(df: DataFrame, key: str, order: list[str], begin: Callable[[], Callable], schema: str) -> DataFrame:
    """begin() gives a step: a function of one row as a dict, or of None at the end of its key, that
    returns the rows to emit."""
    kind = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], schema=kind)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, last = None, None
        out: list[tuple] = []
        for rows in batches:
            for at in range(0, rows.num_rows, 1024):  # Python objects of a part of the batch at a time
                for row in rows.slice(at, 1024).to_pylist():
                    if step is None or row[key] != last:
                        if step is not None:
                            out += step(None)
                        step, last = begin(), row[key]
                    out += step(row)
                if len(out) >= 1024:
                    yield batch(out)
                    out = []
        if step is not None:
            out += step(None)
        if out:
            yield batch(out)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(task, schema)


def claims(ops: DataFrame) -> DataFrame:
    """Set-if-absent with a window: of ops(key, pos, ts_ms, ttl_ms, value), those accepted. A claim holds
    until its own expiry; refused ones do not extend it; ttl_ms 0 holds for good."""

    def begin():
        state = {"until": None}

        def step(row):
            if row is None or state["until"] is not None and (state["until"] == 0 or row["ts_ms"] < state["until"]):
                return []
            state["until"] = row["ts_ms"] + row["ttl_ms"] if row["ttl_ms"] else 0
            return [(row["key"], row["pos"], row["ts_ms"], row["value"], state["until"])]

        return step

    return stream_fold(ops, "key", ["pos"], begin, "key string, pos long, ts_ms long, value string, expires_at_ms long")


def counters(ops: DataFrame) -> DataFrame:
    """The value after each of ops(key, pos, op, n), op INCRBY, DECRBY, SET or DEL, where nothing is
    rejected: running sums that start anew at each SET and DEL. Missing counts as 0."""
    resets = F.col("op").isin("SET", "DEL")
    by_key = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = Window.partitionBy("key", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    delta = F.when(F.col("op") == "DECRBY", -F.col("n")).when(F.col("op") == "DEL", F.lit(0)).otherwise(F.col("n"))
    numbered = ops.withColumn("run", F.sum(resets.cast("long")).over(by_key))
    return numbered.select("key", "pos", "op", F.when(F.col("op") != "DEL", F.sum(delta).over(run)).alias("value"))


def parse_counter(text: str | None) -> int | None:
    """A stored counter: blanks before and a sign are fine, anything else after is not."""
    try:
        digits = text.lstrip(" \t\n\v\f\r")
        value = int(digits) if digits[-1:].isdigit() and digits.isascii() and "_" not in digits else None
    except (ValueError, AttributeError):
        return None
    return value if value is not None and MIN_INT64 <= value <= MAX_INT64 else None


def checked_counters(ops: DataFrame) -> DataFrame:
    """As counters(), of ops(key, pos, op, arg) with arg as text: an operation on something that is no
    integer, or that overflows, gets an error and leaves the state as it was."""

    def begin():
        state = {"text": None}

        def step(row):
            if row is None:
                return []
            op, error, value = row["op"], None, None
            if op == "SET":
                state["text"] = row["arg"]
            elif op == "DEL":
                state["text"] = None
            else:
                now = 0 if state["text"] is None else parse_counter(state["text"])
                by = parse_counter(row["arg"])
                if now is None or by is None or row["arg"][:1] in " +":
                    error = "value is not an integer"
                elif op == "DECRBY" and by == MIN_INT64 or not MIN_INT64 <= (value := now + (by if op == "INCRBY" else -by)) <= MAX_INT64:
                    error, value = "counter overflow", None
                else:
                    state["text"] = str(value)
            return [(row["key"], row["pos"], op, value, error)]

        return step

    return stream_fold(ops, "key", ["pos"], begin, "key string, pos long, op string, value long, error string")


def lists(ops: DataFrame) -> DataFrame:
    """The list of each key after ops(key, pos, op, n), op LPUSH, RPUSH, LPOP or RPOP; keys whose list is
    empty are gone."""

    def begin():
        held: deque = deque()
        name: list[str] = []

        def step(row):
            if row is None:
                return [(name[0], [str(x) for x in held])] if held else []
            name[:] = [row["key"]]
            if row["op"] == "LPUSH":
                held.appendleft(row["n"])
            elif row["op"] == "RPUSH":
                held.append(row["n"])
            elif held:
                held.popleft() if row["op"] == "LPOP" else held.pop()
            return []

        return step

    return stream_fold(ops, "key", ["pos"], begin, "key string, items array<string>")


def lru_hits(trace: DataFrame, capacity: int) -> DataFrame:
    """trace(shard, pos, key): whether each access hits a least-recently-used cache of each shard."""

    def begin():
        held: OrderedDict = OrderedDict()

        def step(row):
            if row is None:
                return []
            hit = row["key"] in held
            held[row["key"]] = True
            held.move_to_end(row["key"])
            if len(held) > capacity:
                held.popitem(last=False)
            return [(row["shard"], row["pos"], hit and capacity > 0)]

        return step

    return stream_fold(trace, "shard", ["pos"], begin, "shard string, pos long, hit boolean")


def cache_trace(ops: DataFrame, capacity: int, default_ttl_ms: int = 0) -> DataFrame:
    """Replay of ops(shard, pos, ts_ms, op, key, ttl_ms), op GET, PUT, ERASE or CONTAINS, on a least-recently-used cache
    of each shard. ttl_ms below 0 or null means the default, 0 none; an entry is gone from the millisecond of its
    expiry. outcome: hit, miss or expired (a miss too) of a GET, yes, no or expired of a CONTAINS, put and erased of
    the others; evicted: how many entries a PUT pushed out. Only GET and PUT make a key recent."""

    def begin():
        held: OrderedDict[str, int] = OrderedDict()  # key -> expiry, 0 for none

        def step(row):
            if row is None:
                return []
            op, key, now, evicted = row["op"], row["key"], row["ts_ms"], 0
            if op == "PUT":
                ttl = row["ttl_ms"] if row["ttl_ms"] is not None and row["ttl_ms"] >= 0 else default_ttl_ms
                outcome = "put"
                if capacity > 0:
                    held[key] = now + ttl if ttl > 0 else 0
                    held.move_to_end(key)
                    if len(held) > capacity:
                        held.popitem(last=False)
                        evicted = 1
            elif op == "ERASE":
                held.pop(key, None)
                outcome = "erased"
            elif key not in held:
                outcome = "miss" if op == "GET" else "no"
            elif held[key] and held[key] <= now:
                del held[key]
                outcome = "expired"
            else:
                outcome = "hit" if op == "GET" else "yes"
                if op == "GET":
                    held.move_to_end(key)
            return [(row["shard"], row["pos"], op, outcome, evicted)]

        return step

    return stream_fold(ops, "shard", ["pos"], begin, "shard string, pos long, op string, outcome string, evicted int")


def read_cache(ops: DataFrame, capacity: int) -> DataFrame:
    """Where reads are answered: replay of ops(part, pos, ts_ms, op, key, expires_at_ms), op GET, PUT, DEL or FLUSH, with a
    cache of values in front of the files. What was written since the last FLUSH is answered from memory. Only what is read
    from files is cached, only values without an expiry, and any write takes its key out.

    source of each GET: memory, cache, file, or none if there is no live value."""

    def begin():
        memory: dict[str, int | None] = {}  # key -> expiry, null for a deletion
        files: dict[str, int | None] = {}
        cache: OrderedDict[str, bool] = OrderedDict()

        def step(row):
            if row is None:
                return []
            op, key, now = row["op"], row["key"], row["ts_ms"]
            if op == "FLUSH":
                files.update(memory)
                memory.clear()
                return []
            if op in ("PUT", "DEL"):
                memory[key] = (row["expires_at_ms"] or 0) if op == "PUT" else None
                cache.pop(key, None)
                return []
            if key in cache and key not in memory:
                cache.move_to_end(key)
                return [(row["part"], row["pos"], "cache")]
            place, expiry = ("memory", memory[key]) if key in memory else ("file", files.get(key))
            if expiry is None or 0 < expiry <= now:
                return [(row["part"], row["pos"], "none")]
            if place == "file" and not expiry and capacity > 0:
                cache[key] = True
                if len(cache) > capacity:
                    cache.popitem(last=False)
            return [(row["part"], row["pos"], place)]

        return step

    return stream_fold(ops, "part", ["pos"], begin, "part string, pos long, source string")


def cache_shards(ops: DataFrame, shards: int, of: str = "key") -> DataFrame:
    """The shard of each operation by a hash of its key; capacities of shards are the whole's share."""
    return ops.withColumn("shard", F.pmod(F.crc32(F.col(of).cast("binary")), F.lit(shards)).cast("string"))


def cache_counts(trace: DataFrame) -> DataFrame:
    """hits, misses, evictions and expiries by shard of a cache_trace()."""
    return trace.groupBy("shard").agg(
        F.count_if(F.col("outcome") == "hit").alias("hits"), F.count_if((F.col("op") == "GET") & F.col("outcome").isin("miss", "expired")).alias("misses"),
        F.sum("evicted").alias("evictions"), F.count_if(F.col("outcome") == "expired").alias("expiries"),
    )


def lfu_hits(trace: DataFrame, capacity: int) -> DataFrame:
    """As lru_hits() for a least-frequently-used cache; of the keys used least, the one that has had its
    count for longest goes."""

    def begin():
        buckets: dict[int, OrderedDict] = {}
        count: dict[str, int] = {}

        def touch(key, n):
            buckets.setdefault(n, OrderedDict())[key] = True
            count[key] = n

        def step(row):
            if row is None:
                return []
            key, hit = row["key"], row["key"] in count
            if hit:
                n = count[key]
                del buckets[n][key]
                if not buckets[n]:
                    del buckets[n]
                touch(key, n + 1)
            elif capacity > 0:
                if len(count) >= capacity:
                    least = min(buckets)
                    old, _ = buckets[least].popitem(last=False)
                    del count[old]
                    if not buckets[least]:
                        del buckets[least]
                touch(key, 1)
            return [(row["shard"], row["pos"], hit)]

        return step

    return stream_fold(trace, "shard", ["pos"], begin, "shard string, pos long, hit boolean")
