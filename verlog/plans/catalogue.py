"""Named queries over the fixture tables. `oracle` has the SQL that each of them equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import collections as C
from ..functions import encodings
from ..operators import bloom, commands, folds, hashes, ring, storage, txn, visible, writes
from ..schema import LOG
from ..sources import fixtures as X
from ..sources import manifest, paths, resp, wal
from ..streaming import claims as stream_claims
from ..streaming import ingest
from .oracle import SQL

NOW_MS = 1_706_000_000_000
LATER_MS = 1_707_000_000_000
SNAPSHOT = 8_000

Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, Query] = {}


def query(f: Query) -> Query:
    _all[f.__name__] = f
    return f


def _customers(spark, d) -> DataFrame:
    """A request for each customer, by position; those with even keys ask for keys that exist."""
    return X.table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("cust:"), "c_custkey").alias("key"))


@query
def kv_live_state(spark, d):
    return visible.live(X.events_log(spark, d), NOW_MS)


@query
def kv_live_orders(spark, d):
    return visible.live(X.orders_log(spark, d), NOW_MS)


@query
def kv_snapshot_state(spark, d):
    return visible.live(X.events_log(spark, d), NOW_MS, upto=SNAPSHOT)


@query
def kv_get_point(spark, d):
    return visible.get(X.orders_log(spark, d), "cust:7", NOW_MS).select("key", "value", "seq")


@query
def kv_mget_positional(spark, d):
    return visible.mget(X.orders_log(spark, d), _customers(spark, d), NOW_MS)


@query
def kv_mget_negative(spark, d):
    return visible.mget(X.orders_log(spark, d), _customers(spark, d).withColumn("key", F.concat(F.lit("missing"), "pos")), NOW_MS)


@query
def kv_exists(spark, d):
    return visible.exists(X.orders_log(spark, d), _customers(spark, d), NOW_MS)


@query
def kv_scan_range_limit(spark, d):
    return visible.scan(X.orders_log(spark, d), NOW_MS, "cust:1", "cust:5", limit=100)


@query
def kv_scan_range_all(spark, d):
    return visible.scan(X.orders_log(spark, d), NOW_MS, "cust:1", "cust:5")


@query
def kv_scan_flat(spark, d):
    return visible.scan_reply(visible.scan(X.orders_log(spark, d), NOW_MS, "cust:2", limit=100))


@query
def kv_prefix(spark, d):
    return visible.prefix(X.orders_log(spark, d), "cust:12", NOW_MS)


@query
def kv_next_key(spark, d):
    """Each live key with the one after it."""
    return visible.next_keys(visible.live(X.orders_log(spark, d), NOW_MS))


@query
def kv_seek(spark, d):
    return visible.seek(X.orders_log(spark, d), "cust:33", NOW_MS)


@query
def kv_versions_order(spark, d):
    v = X.events_log(spark, d)
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq"), "type"))
    return v.select("key", "seq", "type", nth.cast("long").alias("nth"))


@query
def kv_deleted_keys(spark, d):
    return visible.latest(X.events_log(spark, d)).where("type = 1").select("key", "seq")


@query
def kv_expired_keys(spark, d):
    return visible.latest(X.events_log(spark, d)).where(visible.expired(LATER_MS)).select("key", "seq", "expires_at_ms")


@query
def kv_ttl(spark, d):
    log = X.events_log(spark, d)
    users = X.table(spark, d, "events").select(F.col("user_id").alias("pos")).distinct().withColumn("key", F.concat(F.lit("user:"), F.col("pos") - 1))
    return visible.pttl(log, users, NOW_MS)


@query
def kv_ttl_snapshot(spark, d):
    log = X.events_log(spark, d)
    users = X.table(spark, d, "events").select(F.col("user_id").alias("pos")).distinct().withColumn("key", F.concat(F.lit("user:"), "pos"))
    return visible.pttl(log, users, NOW_MS, upto=SNAPSHOT)


@query
def kv_expiry_schedule(spark, d):
    return visible.expiry_schedule(X.events_log(spark, d))


def _expire_requests(spark, d):
    users = X.table(spark, d, "events").select("user_id").distinct()
    return users.select(F.col("user_id").alias("pos"), F.concat(F.lit("user:"), "user_id").alias("key"), ((F.pmod("user_id", F.lit(5)) - 1) * 1000).cast("long").alias("ttl_ms"))


@query
def kv_expire_effect(spark, d):
    return writes.expire(X.events_log(spark, d), _expire_requests(spark, d), NOW_MS)


@query
def kv_persist_effect(spark, d):
    return writes.persist(X.events_log(spark, d), _expire_requests(spark, d).select("pos", "key"), NOW_MS)


def _batch(spark, d):
    return X.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderstatus") == "F", "DEL").otherwise("PUT").alias("op"), F.concat(F.lit("cust:"), "o_custkey").alias("key"),
        F.col("o_orderpriority").alias("value"),
    )


@query
def kv_batch_apply(spark, d):
    return writes.batch(_batch(spark, d), 1_000_001)


@query
def kv_batch_size(spark, d):
    return writes.batch_size(_batch(spark, d))


@query
def kv_latest_seq(spark, d):
    return visible.latest_seq(X.orders_log(spark, d))


@query
def kv_log_faults(spark, d):
    """The reasons for which rows of a log with planted faults are refused."""
    log = X.events_log(spark, d)
    spoilt = log.withColumns({
        "key": F.when(F.pmod("seq", F.lit(97)) == 0, "").otherwise(F.col("key")), "expires_at_ms": F.when(F.col("type") == 1, F.pmod("seq", F.lit(2))).otherwise(F.col("expires_at_ms")),
    })
    from ..schema import split_faulty

    return split_faulty(spoilt)[1].groupBy("reason").agg(F.count("*").alias("n"))


@query
def txn_conflicts(spark, d):
    return txn.conflicts(X.orders_log(spark, d), X.txns(spark, d).select("txn", "start_seq", "key"))


@query
def txn_schedule(spark, d):
    ops = X.txns(spark, d).select(F.col("key").alias("part"), "pos", "txn", "start_seq", F.array("key").alias("keys"))
    return txn.schedule(ops)


@query
def txn_read_own_writes(spark, d):
    t = X.txns(spark, d)
    own = t.where("txn % 3 = 0").select("txn", "pos", F.when(F.col("txn") % 2 == 0, "PUT").otherwise("DEL").alias("op"), "key", "value")
    return txn.read(X.orders_log(spark, d), t.select("txn", "key", "start_seq"), own, NOW_MS)


def _write_trace(spark, d):
    return X.table(spark, d, "lineitem").select(
        F.floor(F.col("l_orderkey") / 10).alias("txn"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.pmod(F.col("l_partkey") * 7 + F.col("l_suppkey"), F.lit(100))).alias("pos"),
        F.when(F.col("l_returnflag") == "R", "DEL").otherwise("PUT").alias("op"), F.concat(F.lit("part:"), F.pmod("l_partkey", F.lit(50))).alias("key"), F.col("l_linestatus").alias("value"),
    )


@query
def txn_write_dedup(spark, d):
    """The last write of each key of a transaction, at the place of the first (positions that tie are
    made unique by keeping one)."""
    w = _write_trace(spark, d).groupBy("txn", "key", "pos").agg(F.min(F.struct("op", "value")).alias("x")).select("txn", "pos", "key", "x.op", "x.value")
    return txn.dedupe_writes(w)


@query
def lock_trace(spark, d):
    """Users lock their event type: views and clicks for reading, purchases for writing; the others unlock."""
    e = X.table(spark, d, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), "S").when(F.col("event_type") == "purchase", "X").otherwise("UNLOCK")
    ops = e.select(F.concat(F.lit("r"), F.pmod("user_id", F.lit(10))).alias("key"), F.col("event_id").alias("pos"), (F.col("user_id") + 1).alias("owner"), kind.alias("op"))
    return txn.locks(ops)


@query
def counter_replay(spark, d):
    return folds.counters(X.counter_ops(spark, d))


@query
def counter_final(spark, d):
    done = folds.counters(X.counter_ops(spark, d))
    last = done.groupBy("key").agg(F.max_by(F.struct("op", "value"), "pos").alias("v"))
    return last.where("v.op <> 'DEL'").select("key", "v.value")


@query
def counter_checked(spark, d):
    """Increments of users' counters by their event numbers times 10^15; what overflows is refused."""
    e = X.table(spark, d, "events")
    op = F.when(F.col("event_type") == "error", "DEL").when(F.col("event_type") == "signup", "SET").otherwise("INCRBY")
    arg = F.when(F.col("event_type") == "signup", "word").when(F.col("event_type") == "view", "9000000000000000000").otherwise(F.col("event_id").cast("string"))
    return folds.checked_counters(e.select(F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_id").alias("pos"), op.alias("op"), arg.alias("arg")))


@query
def hash_hgetall(spark, d):
    whole = hashes.hgetall(X.hash_ops(spark, d))
    return whole.select("key", F.array_join(F.transform("items", lambda x: F.concat(x["field"], F.lit("="), x["value"])), ",").alias("items"))


@query
def hash_hkeys(spark, d):
    return hashes.hkeys(hashes.hgetall(X.hash_ops(spark, d))).select("key", F.array_join("fields", ",").alias("fields"))


@query
def hash_hvals(spark, d):
    return hashes.hvals(hashes.hgetall(X.hash_ops(spark, d))).select("key", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("vals"))


@query
def hash_hlen(spark, d):
    return hashes.hlen(X.hash_ops(spark, d))


@query
def hash_hget(spark, d):
    asked = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("order:"), "o_orderkey").alias("key"), F.concat(F.lit("p"), F.pmod("o_custkey", F.lit(50))).alias("field"))
    return hashes.hget(X.hash_ops(spark, d), asked)


@query
def hash_replies(spark, d):
    out = hashes.replies(X.hash_ops(spark, d))
    return out.select("key", "field", "op", F.col("pos.l_linenumber").alias("line"), F.col("pos.l_suppkey").alias("supp"), "reply")


@query
def hash_hdel_empty_key(spark, d):
    return hashes.emptied(X.hash_ops(spark, d))


def _lists(spark, d):
    return folds.lists(X.list_ops(spark, d))


@query
def list_final(spark, d):
    return _lists(spark, d).select("key", F.array_join("items", ",").alias("items"))


@query
def list_lrange(spark, d):
    inner, tail, none = C.lrange(F.col("items"), 1, 3), C.lrange(F.col("items"), -3, -1), C.lrange(F.col("items"), -20_000, -10_000)
    return _lists(spark, d).select("key", F.array_join(inner, ",").alias("inner_part"), F.array_join(tail, ",").alias("tail_part"), F.array_join(none, ",").alias("before_part"))


@query
def list_lindex(spark, d):
    i = F.col("items")
    return _lists(spark, d).select("key", C.lindex(i, 0).alias("first"), C.lindex(i, -1).alias("last"), C.lindex(i, 2).alias("third"), C.lindex(i, -100_000).alias("none"))


@query
def list_llen(spark, d):
    """The length for every user, 0 where there is no list."""
    users = X.table(spark, d, "events").select(F.concat(F.lit("user:"), "user_id").alias("key")).distinct()
    return users.join(_lists(spark, d), "key", "left").select("key", C.llen(F.col("items")).cast("long").alias("n"))


@query
def nx_claims(spark, d):
    return folds.claims(X.claim_ops(spark, d))


@query
def nx_first_writer(spark, d):
    return writes.put_if_absent(X.claim_ops(spark, d).select("key", (F.col("pos") + 1).alias("seq"), "value"))


@query
def merge_sources(spark, d):
    log = X.events_log(spark, d)
    runs = [log.where(F.pmod("seq", F.lit(3)) == k) for k in range(3)]
    return visible.live(storage.merge(*runs), NOW_MS)


@query
def wal_replay_dedup(spark, d):
    log = X.events_log(spark, d)
    return visible.latest(storage.replay(log, log.where(F.col("seq") > SNAPSHOT // 2))).select("key", "seq", "type")


def _segment(width: int = 1000):
    return F.floor((F.col("seq") - 1) / width)


@query
def wal_segment_retention(spark, d):
    return storage.deletable_segments(X.events_log(spark, d).select(_segment().alias("segment"), "seq"), flushed_seq=SNAPSHOT)


@query
def wal_segment_names(spark, d):
    return X.events_log(spark, d).select(_segment().alias("segment")).distinct().select("segment", F.concat(C.file_number(F.col("segment")), F.lit(".wal")).alias("name"))


@query
def ring_hash(spark, d):
    return _customers(spark, d).select("key", C.fnv(F.col("key")).cast("string").alias("hash"))


@query
def ring_tokens(spark, d):
    return ring.tokens(X.nodes(spark), 8).select("id", F.col("i").cast("long").alias("i"), F.col("token").cast("string").alias("token"))


@query
def ring_route(spark, d):
    return ring.route(_customers(spark, d), X.nodes(spark)).select("pos", "key", "node")


@query
def ring_replicas(spark, d):
    return ring.replicas(_customers(spark, d), X.nodes(spark), 2).select("key", F.col("rank").cast("long").alias("rank"), "node")


@query
def batch_plan(spark, d):
    return ring.plan(_customers(spark, d), X.nodes(spark)).select("pos", "key", "node", F.col("grp").cast("long").alias("grp"), F.col("nth").cast("long").alias("nth"))


@query
def batch_single_node_check(spark, d):
    ops = X.table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 2).alias("batch"), F.concat(F.lit("cust:"), "o_custkey").alias("key"))
    return ring.single_node(ops, X.nodes(spark), "n1")


@query
def cluster_status(spark, d):
    return ring.status(X.nodes(spark))


def _files(spark, d):
    return storage.metadata(X.events_log(spark, d), _segment())


@query
def file_metadata(spark, d):
    return _files(spark, d)


def _levels(spark, d):
    """Files of the order log: the even ones at level 0, the others at level 1."""
    files = storage.metadata(X.orders_log(spark, d), _segment())
    return files.withColumn("level", F.pmod("file_number", F.lit(2)).cast("int"))


@query
def compaction_pick(spark, d):
    return storage.pick(_levels(spark, d)).select("file_number", "level")


@query
def compaction_due(spark, d):
    return storage.due(_levels(spark, d))


@query
def compaction_merge_l1(spark, d):
    return storage.compact(X.events_log(spark, d), 1, NOW_MS)


@query
def compaction_merge_l2(spark, d):
    return storage.compact(X.events_log(spark, d), 2, NOW_MS)


@query
def manifest_live_files(spark, d):
    files = _files(spark, d)
    adds = files.select((F.col("file_number") * 2).alias("pos"), F.lit("add").alias("action"), "file_number")
    removes = files.where(F.pmod("file_number", F.lit(2)) == 0).select((F.col("file_number") * 2 + 5).alias("pos"), F.lit("remove").alias("action"), "file_number")
    return storage.live_files(adds.unionByName(removes))


@query
def range_prune_stats(spark, d):
    users = X.table(spark, d, "events").select(F.col("user_id").alias("pos")).distinct().withColumn("key", F.concat(F.lit("user:"), "pos"))
    return storage.prune_stats(_files(spark, d), users).select("pos", "key", F.col("pruned").cast("long").alias("pruned"), F.col("read").cast("long").alias("must_read"))


def _trace(spark, d):
    return X.table(spark, d, "events").select(F.col("event_type").alias("shard"), F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("key"))


@query
def lru_hits(spark, d):
    return folds.lru_hits(_trace(spark, d), 8)


@query
def lfu_hits(spark, d):
    return folds.lfu_hits(_trace(spark, d), 8)


@query
def cache_stats(spark, d):
    return folds.lru_hits(_trace(spark, d), 8).groupBy("shard").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def _raft(spark, d):
    """The order log as entries; index 1 + 7k is missing from 500 on, and every tenth was written twice."""
    o = X.table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("idx"), (F.floor(F.col("o_orderkey") / 1000) + 1).alias("term"), F.col("o_orderstatus").alias("data"))
    again = o.where("idx % 10 = 0").select("idx", (F.col("term") + 1).alias("term"), F.lit("again").alias("data"))
    return o.unionByName(again).where("not (idx >= 500 and idx % 7 = 1)")


@query
def raft_apply_prefix(spark, d):
    return storage.committed_prefix(_raft(spark, d), 2_000)


@query
def raft_apply_most(spark, d):
    """The prefix of all orders as entries, up to the first gap, which lies in the last tenth of them."""
    o = X.table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("idx"), F.lit(1).cast("long").alias("term"), F.col("o_orderstatus").alias("data"))
    last = F.broadcast(o.agg(F.max("idx").alias("last")))  # one row
    return storage.committed_prefix(o.crossJoin(last).where("not (idx * 10 > last * 9 and idx % 5 = 2)").drop("last"), 1 << 40)


@query
def raft_commit_index(spark, d):
    match = X.table(spark, d, "nation").select(F.col("n_name").alias("node"), (F.col("n_nationkey") * 60 + F.col("n_regionkey")).cast("long").alias("match_index"))
    return storage.commit_index(match, _raft(spark, d), 1)


def _command_lines(spark, d):
    """A line of text for each event."""
    e = X.table(spark, d, "events")
    user, n = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    line = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("get s:"), user))
        .when(F.col("event_type") == "click", F.concat(F.lit("SET s:"), user, F.lit(" v"), n, F.when(F.pmod("event_id", F.lit(3)) == 0, " EX 3600").otherwise("")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("INCRBY c:"), user, F.lit(" "), n))
        .when(F.col("event_type") == "signup", F.concat(F.lit("LPUSH l:"), user, F.lit(" "), n))
        .otherwise(F.when(F.pmod("event_id", F.lit(2)) == 0, F.concat(F.lit("nonsense "), n)).otherwise(F.concat(F.lit("EXPIRE s:"), user, F.lit(" x"))))
    )
    return e.select(F.concat(F.lit("u"), user).alias("part"), F.col("event_id").alias("pos"), X.epoch_ms("ts").alias("ts_ms"), F.concat(F.lit("s"), user).alias("session"), line.alias("line"))


@query
def command_parse(spark, d):
    return commands.parse(_command_lines(spark, d)).select("pos", "op", "kind", F.col("argc").cast("long").alias("argc"))


@query
def command_replay(spark, d):
    return commands.replay(_command_lines(spark, d))


@query
def command_metrics(spark, d):
    return commands.metrics(commands.replay(_command_lines(spark, d)))


def _sampled_files(spark, d):
    return X.events_log(spark, d).select(_segment().alias("file_number"), "key")


@query
def bloom_words(spark, d):
    return bloom.build(_sampled_files(spark, d))


@query
def bloom_probe(spark, d):
    """For every file, the filter's word on all users and on as many keys that no file has."""
    users = X.table(spark, d, "events").select("user_id").distinct()
    asked = users.select(F.concat(F.lit("user:"), "user_id").alias("key")).union(users.select(F.concat(F.lit("none:"), "user_id")))
    return bloom.may_contain_all(_sampled_files(spark, d), asked)


@query
def ttl_reclaim(spark, d):
    return storage.reclaim(X.events_log(spark, d), LATER_MS)


@query
def ttl_purge_list(spark, d):
    """The keys that are due, in byte order."""
    due = visible.expiry_schedule(X.events_log(spark, d)).where(visible.expired(LATER_MS))
    return due.orderBy("key").select("key", "expires_at_ms")


@query
def raft_apply_commands(spark, d):
    e = X.table(spark, d, "events")
    op = F.when(F.col("event_type") == "view", "S").when(F.col("event_type") == "click", "T").when(F.col("event_type") == "purchase", "E").when(F.col("event_type") == "error", "D").otherwise("N")
    ts = X.epoch_ms("ts")
    return storage.apply_commands(e.select((F.col("event_id") + 1).alias("idx"), op.alias("op"), F.concat(F.lit("user:"), "user_id").alias("key"), F.col("props").alias("value"), (ts + 3_600_000).alias("expires_at_ms"), ts.alias("ts_ms")))


@query
def manifest_dump(spark, d):
    """File metadata with keys in hexadecimal, as an administrator's listing shows them."""
    return _files(spark, d).select("file_number", "level", F.lower(F.hex("smallest")).alias("smallest"), F.lower(F.hex("largest")).alias("largest"), "max_seq")


@query
def key_sets_union(spark, d):
    """All keys that a transaction reads or writes, each once."""
    t = X.txns(spark, d)
    return t.select("txn", "key").unionByName(t.where("txn % 3 = 0").select("txn", F.concat("key", F.lit("#")).alias("key"))).unionByName(t.select("txn", "key")).distinct()


@query
def crc32_check(spark, d):
    log = X.orders_log(spark, d)
    return log.select("seq", F.crc32(F.concat("key", F.lit("|"), F.coalesce("value", F.lit(""))).cast("binary")).alias("crc"))


LAST = 1 << 40  # a sequence number after all of a log's


@query
def kv_put_delete(spark, d):
    """The live state after two puts and two deletions more, one of a key that is not there."""
    more = [writes.put(spark, "cust:7", "new", LAST), writes.put(spark, "fresh", "x", LAST + 1, 1000, NOW_MS), writes.delete(spark, "cust:8", LAST + 2), writes.delete(spark, "none", LAST + 3)]
    return visible.live(storage.merge(X.orders_log(spark, d), *more), NOW_MS)


@query
def wal_round_trip(spark, d):
    """The event log, written as binary segments and read back."""
    folder = paths.new_folder(spark, "wal")
    wal.write_segments(X.events_log(spark, d), folder, 100_000).agg(F.sum("records")).collect()
    return wal.read(spark, folder).select(F.col("key").cast("string").alias("key"), "seq", "type", F.col("value").cast("string").alias("value"), "expires_at_ms")


@query
def resp_round_trip(spark, d):
    """Every customer's GET as request files of the wire protocol, read back: how many arguments, and the key."""
    folder = paths.new_folder(spark, "requests")
    resp.write(_customers(spark, d).select("pos", F.array(F.lit("GET"), "key").alias("args")), folder).agg(F.sum("requests")).collect()
    return resp.read(spark, folder).select(F.size("args").cast("long").alias("argc"), F.get("args", F.lit(1)).alias("key"), "fault")


def _stored_run(spark, d) -> DataFrame:
    folder = paths.new_folder(spark, "run")
    storage.write_run(X.orders_log(spark, d), folder, files=8)
    return spark.read.schema(LOG).parquet(folder)


@query
def run_point_get(spark, d):
    """A point read of a stored run: the key's predicate reaches the files' statistics and bloom filters."""
    return visible.get(_stored_run(spark, d), "cust:7", NOW_MS).select("key", "value", "seq")


@query
def run_range_scan(spark, d):
    return visible.scan(_stored_run(spark, d), NOW_MS, "cust:1", "cust:5")


@query
def store_compacted(spark, d):
    """What a store holds after its compaction is committed."""
    store = storage.Store(spark, paths.new_folder(spark, "store"))
    store.commit(X.events_log(spark, d))
    store.compact(NOW_MS)
    return store.read()


@query
def store_installed(spark, d):
    """The live state after a checkpoint of the order log is installed over an open event log."""
    store, other = (storage.Store(spark, paths.new_folder(spark, "store")) for _ in "ab")
    store.commit(X.events_log(spark, d))
    other.commit(X.orders_log(spark, d))
    other.checkpoint(at := paths.new_folder(spark, "checkpoint"))
    store.install(at)
    return visible.live(store.read(), NOW_MS)


@query
def snapshot_read(spark, d):
    """What a snapshot taken half way sees of the log as it is now."""
    log, held = X.events_log(spark, d), visible.Snapshots()
    taken = held.take(log.where(F.col("seq") <= SNAPSHOT // 2))
    seen = visible.live(log, NOW_MS, upto=held.seq(taken))
    held.release(taken)
    return seen


def _by_nation(spark, d, columns: str, rows: list[tuple]) -> DataFrame:
    """Rows of a small table (i, …) once for each nation: nation, its number k, and pos = 100 k + i."""
    nations = X.table(spark, d, "nation").select(F.col("n_name").alias("nation"), F.col("n_nationkey").cast("long").alias("k"))
    small = F.broadcast(spark.createDataFrame(rows, f"i long, {columns}"))
    return nations.crossJoin(small).withColumn("pos", F.col("k") * 100 + F.col("i"))


@query
def pessimistic_trace(spark, d):
    """A writer that holds a lock and, in every other nation, rolls back; a second one that has to wait."""
    rows = [(1, 1, "PUT", "k", "a"), (2, 2, "PUT", "k", "b"), (3, 2, "GET", "k", None), (4, 1, "GET", "k", None), (5, 1, "END", None, None), (6, 2, "GET", "k", None), (7, 2, "DEL", "k", None), (8, 2, "COMMIT", None, None), (9, 3, "GET", "k", None)]
    ops = _by_nation(spark, d, "txn long, op string, key string, value string", rows)
    op = F.when(F.col("op") == "END", F.when(F.col("k") % 2 == 0, "COMMIT").otherwise("ROLLBACK")).otherwise(F.col("op"))
    return txn.pessimistic(ops.select(F.col("nation").alias("part"), "pos", "txn", op.alias("op"), "key", "value"))


@query
def counter_limits(spark, d):
    """Counters at the ends of their range."""
    low = "-9223372036854775808"
    rows = [(1, "DECRBY", low), (2, "INCRBY", low), (3, "DECRBY", "1"), (4, "INCRBY", "+1"), (5, "INCRBY", "9223372036854775807"), (6, "DECRBY", "-1"), (7, "SET", " 12"), (8, "INCRBY", "1"), (9, "DEL", None), (10, "DECRBY", "5")]
    ops = _by_nation(spark, d, "op string, arg string", rows)
    return folds.checked_counters(ops.select(F.col("nation").alias("key"), "pos", "op", "arg"))


@query
def list_queue_and_stack(spark, d):
    """The same pushes and pops as a queue and as a stack."""
    rows = [(i, kind, op, n) for kind in ("queue", "stack") for i, (op, n) in enumerate([("PUSH", 1), ("PUSH", 2), ("LPOP", None), ("PUSH", 3), ("PUSH", 4), ("LPOP", None)])]
    ops = _by_nation(spark, d, "kind string, op string, n long", rows)
    op = F.when(F.col("op") == "PUSH", F.when(F.col("kind") == "queue", "RPUSH").otherwise("LPUSH")).otherwise(F.col("op"))
    done = folds.lists(ops.select(F.concat_ws(":", "kind", "nation").alias("key"), "pos", op.alias("op"), "n"))
    return done.select("key", F.array_join("items", ",").alias("items"))


SESSION = [
    "a GET x", "a AUTH no", "a AUTH pw", "b AUTH pw", "a SET x 1", "a BEGIN", "a GET x", "a SET x 2", "a GET x", "a INCR x", "b {other}", "a INFO more", "a CLUSTER BATCH SET x 1", "a EXEC", "b GET x", "b BEGIN",
    "b BEGIN", "b DEL x", "b ABORT", "b GET x", "a EXEC", "a CLUSTER", "a CLUSTER STATUS", "a AUTH", "a BEGIN now", "c GET x", "a HSET x f v", "a nonsense",
]


@query
def command_sessions(spark, d):
    """Sessions that log in and run transactions; in every other nation the second one interferes."""
    rows = [(i, *line.split(" ", 1)) for i, line in enumerate(SESSION)]
    lines = _by_nation(spark, d, "session string, line string", rows)
    line = F.replace("line", F.lit("{other}"), F.when(F.col("k") % 2 == 0, "SET x 9").otherwise("GET x"))
    return commands.replay(lines.select(F.col("nation").alias("part"), "pos", F.lit(NOW_MS).alias("ts_ms"), "session", line.alias("line")), "pw")


@query
def cluster_replies(spark, d):
    """Where the cluster routes each customer, and its other replies once for each nation."""
    routes = _customers(spark, d).select(F.concat(F.lit("r"), F.pmod("pos", F.lit(8))).alias("part"), (F.col("pos") + 10_000).alias("pos"), F.concat(F.lit("CLUSTER ROUTE "), "key").alias("line"))
    rows = [(i, line) for i, line in enumerate(["CLUSTER STATUS", "cluster status n2", "CLUSTER STATUS n9", "CLUSTER ROUTE", "CLUSTER ROUTE a 0", "CLUSTER what", "CLUSTER BATCH SET a", "CLUSTER BATCH DEL", "CLUSTER BATCH ADD a", "STATS", "INFO x", "GET a"])]
    more = _by_nation(spark, d, "line string", rows).select(F.col("nation").alias("part"), "pos", "line")
    lines = routes.unionByName(more).select("part", "pos", F.lit(NOW_MS).alias("ts_ms"), F.lit("s").alias("session"), "line")
    return commands.replay(lines, nodes=X.NODES, local="n1")


@query
def ring_membership(spark, d):
    """Nations that join, leave, fail, come back and join anew."""
    rows = [(0, "ADD", "h", 1), (1, "REMOVE", None, 5), (2, "DEAD", None, 3), (3, "ALIVE", None, 6), (4, "ADD", "again", 10)]
    e = _by_nation(spark, d, "action string, host string, every long", rows).where("(k + case action when 'REMOVE' then 4 when 'ADD' then 9 * (every div 10) else 0 end) % every = 0")
    return ring.membership(e.select("pos", "action", F.col("nation").alias("id"), "host", F.col("k").cast("int").alias("port"), F.pmod("k", F.lit(3)).cast("int").alias("weight"), (F.col("host") == "h").alias("alive")))


@query
def ring_route_all(spark, d):
    return ring.route_all(_customers(spark, d), X.nodes(spark)).select("pos", "key", "node")


def _appends(spark, d) -> DataFrame:
    """The orders as entries of term 1; each hundredth is written again by a later term after thirty more, and each
    seventh is sent twice."""
    o = X.table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("idx"), F.col("o_orderstatus").alias("data"))
    once = o.select((F.col("idx") * 4).alias("pos"), "idx", F.lit(1).cast("long").alias("term"), "data")
    again = o.where("idx % 7 = 0").select((F.col("idx") * 4 + 41).alias("pos"), "idx", F.lit(1).cast("long").alias("term"), "data")
    other = o.where("idx % 100 = 40").select((F.col("idx") * 4 + 122).alias("pos"), "idx", (F.floor(F.col("idx") / 100) + 2).alias("term"), F.lit("other").alias("data"))
    return once.unionByName(again).unionByName(other)


@query
def raft_truncated_log(spark, d):
    return storage.truncate_conflicts(_appends(spark, d), width=256)


@query
def raft_compacted_log(spark, d):
    return storage.compact_entries(storage.truncate_conflicts(_appends(spark, d)), 500)


@query
def raft_lag(spark, d):
    match = X.table(spark, d, "nation").select(F.col("n_name").alias("node"), (F.col("n_nationkey") * 60 + F.col("n_regionkey")).cast("long").alias("match_index"))
    return storage.replication_lag(match, _raft(spark, d))


@query
def manifest_recovered(spark, d):
    """The live files after a binary manifest of adds and removals is written and read back."""
    files = _files(spark, d).withColumn("file_number", F.col("file_number") + 1)
    adds = files.select(
        (F.col("file_number") * 2).alias("pos"), F.lit("add").alias("action"), "file_number", "max_seq", F.concat(F.lit("f"), "file_number").alias("path"), "level", "bytes",
        F.col("smallest").cast("binary").alias("smallest"), F.col("largest").cast("binary").alias("largest"),
    )
    gone = adds.where(F.pmod("file_number", F.lit(2)) == 1).withColumns({"pos": F.col("pos") + 5, "action": F.lit("remove")})
    manifest.write(spark, adds.unionByName(gone), at := f"{paths.new_folder(spark, 'manifest')}/MANIFEST")
    found = manifest.read(spark, at)
    live = storage.live_files(found).select("file_number")
    return found.where("action = 'add'").join(live, "file_number").select("file_number", "max_seq", "path", "level", "bytes", F.col("smallest").cast("string").alias("smallest"), F.col("largest").cast("string").alias("largest"))


@query
def file_listing(spark, d):
    return storage.file_list(_levels(spark, d)).withColumn("nth", F.col("nth").cast("long"))


def _deadline_ops(spark, d) -> DataFrame:
    e = X.table(spark, d, "events")
    op = F.when(F.col("event_type") == "error", "ERASE").otherwise("SET")
    return e.select(F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_id").alias("pos"), X.epoch_ms("ts").alias("ts_ms"), op.alias("op"), ((F.pmod("event_id", F.lit(4)) - 1) * X.DAY_MS).alias("ttl_ms"))


@query
def ttl_deadlines(spark, d):
    """Which keys have a deadline after sets with own, default and no times, and erasures; and whether it is past."""
    held = visible.deadlines(_deadline_ops(spark, d), default_ttl_ms=3_600_000)
    due, stay = visible.purge(held, NOW_MS)
    return due.withColumn("purged", F.lit(True)).unionByName(stay.withColumn("purged", F.lit(False)))


@query
def raft_commands(spark, d):
    """Replicated commands as bytes, and what is read back from them."""
    e = X.table(spark, d, "events")
    op = F.when(F.col("event_type") == "view", "S").when(F.col("event_type") == "click", "T").when(F.col("event_type") == "purchase", "E").when(F.col("event_type") == "error", "D").otherwise("N")
    rows = e.select("event_id", op.alias("op"), F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_type").alias("value"), X.epoch_ms("ts").alias("at"))
    coded = rows.select("event_id", encodings.encode_command(F.col("op"), F.col("key"), F.col("value"), F.col("at")).alias("data"))
    back = encodings.decode_command(F.col("data"))
    return coded.withColumn("c", back).select("event_id", F.lower(F.hex("data")).alias("bytes"), "c.op", "c.key", "c.value", "c.expires_at_ms")


@query
def hash_encoded(spark, d):
    """The stored bytes of each hash, in hexadecimal."""
    return hashes.hgetall(X.hash_ops(spark, d)).select("key", F.lower(F.hex(encodings.encode_hash(F.col("items")))).alias("bytes"))


@query
def hash_decoded(spark, d):
    """Fields and values in turn, read back from the stored bytes."""
    stored = hashes.hgetall(X.hash_ops(spark, d)).select("key", encodings.encode_hash(F.col("items")).alias("data"))
    return encodings.decode_column(stored, "data", hashes=True).select("key", F.array_join("items", ",").alias("items"))


@query
def list_encoded(spark, d):
    return _lists(spark, d).select("key", F.lower(F.hex(encodings.encode_list(F.col("items")))).alias("bytes"))


@query
def list_decoded(spark, d):
    stored = _lists(spark, d).select("key", encodings.encode_list(F.col("items")).alias("data"))
    return encodings.decode_column(stored, "data").select("key", F.array_join("items", ",").alias("items"))


@query
def value_envelopes(spark, d):
    """The stored bytes of values, with their expiry in front if they have one, and what is read back from them."""
    log = X.events_log(spark, d).where("type = 0")
    stored = log.withColumn("data", encodings.encode_value(F.col("value"), F.col("expires_at_ms")))
    value, expiry = encodings.decode_value(F.col("data"))
    return stored.select("seq", F.lower(F.hex("data")).alias("bytes"), value.cast("string").alias("value"), expiry.alias("expires_at_ms"))


@query
def follower_replies(spark, d):
    """What a follower answers: reads from its state, a redirection of writes."""
    return commands.replay(_command_lines(spark, d), leader="127.0.0.1:7001").select("part", "pos", "op", "reply")


def _cache_ops(spark, d) -> DataFrame:
    """GETs, PUTs with and without an expiry, ERASEs and CONTAINS of fifty keys."""
    e = X.table(spark, d, "events")
    kind = F.col("event_type")
    op = F.when(kind == "view", "GET").when(kind.isin("click", "purchase"), "PUT").when(kind == "signup", "CONTAINS").otherwise("ERASE")
    ttl = F.when(kind == "click", F.pmod("event_id", F.lit(3)) * 3_600_000).cast("long")
    return e.select(F.pmod("user_id", F.lit(4)).cast("string").alias("shard"), F.col("event_id").alias("pos"), X.epoch_ms("ts").alias("ts_ms"), op.alias("op"), F.pmod("user_id", F.lit(48)).cast("string").alias("key"), ttl.alias("ttl_ms"))


@query
def read_sources(spark, d):
    """Where reads of users' values are answered, with a flush after each hundred events."""
    e = X.table(spark, d, "events")
    kind, ts = F.col("event_type"), X.epoch_ms("ts")
    op = F.when(kind.isin("view", "click"), "GET").when(kind == "error", "DEL").otherwise("PUT")
    ops = e.select(F.pmod("user_id", F.lit(4)).cast("string").alias("part"), (F.col("event_id") * 2).alias("pos"), ts.alias("ts_ms"), op.alias("op"), F.concat(F.lit("user:"), "user_id").alias("key"),
                   F.when(kind == "signup", ts + 3_600_000).otherwise(F.lit(0)).alias("expires_at_ms"))
    none = F.lit(None)
    parts = F.explode(F.array(*(F.lit(str(k)) for k in range(4))))
    flushes = e.where("event_id % 100 = 99").select(parts.alias("part"), (F.col("event_id") * 2 + 1).alias("pos"), ts.alias("ts_ms"), F.lit("FLUSH").alias("op"), none.cast("string").alias("key"), none.cast("long").alias("expires_at_ms"))
    return folds.read_cache(ops.unionByName(flushes), 1 << 30)


@query
def cache_trace(spark, d):
    return folds.cache_trace(_cache_ops(spark, d), 8).withColumn("evicted", F.col("evicted").cast("long"))


@query
def cache_counts(spark, d):
    return folds.cache_counts(folds.cache_trace(_cache_ops(spark, d), 8))


@query
def stream_ingested(spark, d):
    """The live state of a log that a stream has taken in from a folder of files."""
    source, log, marks = (paths.new_folder(spark, x) for x in ("incoming", "log", "marks"))
    X.orders_log(spark, d).repartition(4, "key").write.parquet(source)
    ingest.follow(spark, source, log, marks, files_per_batch=2).awaitTermination()
    return visible.live(ingest.read_log(spark, log), NOW_MS)


@query
def stream_claimed(spark, d):
    """The claims that a stream accepts, its state expired by timers."""
    source, out, marks = (paths.new_folder(spark, x) for x in ("claims", "taken", "marks"))
    X.claim_ops(spark, d).select("key", "pos", "ts_ms", "ttl_ms").write.parquet(source)
    stream = stream_claims.claims(spark.readStream.schema("key string, pos long, ts_ms long, ttl_ms long").parquet(source))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def queries() -> dict[str, Query]:
    return dict(_all)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
