import random
from collections import OrderedDict

import pytest

from verlog.operators import folds, hashes, txn


def test_claims_window_starts_at_the_accepted_claim(spark):
    rows = [("k", 0, 0, 100, "a"), ("k", 1, 99, 100, "b"), ("k", 2, 100, 100, "c"), ("k", 3, 150, 0, "d"), ("k", 4, 200, 0, "e"), ("k", 5, 10**9, 5, "f"), ("x", 6, 7, 5, "g")]
    ops = spark.createDataFrame(rows, "key string, pos long, ts_ms long, ttl_ms long, value string")
    assert sorted((r.key, r.value) for r in folds.claims(ops).collect()) == [("k", "a"), ("k", "c"), ("k", "e"), ("x", "g")]


def test_counters_reset_and_sum(spark):
    rows = [("c", 0, "INCRBY", 100), ("c", 1, "DECRBY", 1), ("c", 2, "DECRBY", 50), ("c", 3, "SET", 10), ("c", 4, "INCRBY", 5), ("c", 5, "DEL", None), ("c", 6, "INCRBY", 1)]
    got = folds.counters(spark.createDataFrame(rows, "key string, pos long, op string, n long")).orderBy("pos").collect()
    assert [r.value for r in got] == [100, 99, 49, 10, 15, None, 1]


def test_checked_counters_keep_state_on_errors(spark):
    most = str(2**63 - 1)
    rows = [("c", 0, "SET", most), ("c", 1, "INCRBY", "1"), ("c", 2, "DECRBY", "1"), ("c", 3, "DECRBY", str(-(2**63))), ("c", 4, "SET", "12x"), ("c", 5, "INCRBY", "1"), ("c", 6, "SET", " +12"), ("c", 7, "INCRBY", "1"), ("c", 8, "INCRBY", "+1"), ("c", 9, "INCRBY", "1.5")]
    got = folds.checked_counters(spark.createDataFrame(rows, "key string, pos long, op string, arg string")).orderBy("pos").collect()
    assert [(r.value, r.error) for r in got] == [
        (None, None), (None, "counter overflow"), (2**63 - 2, None), (None, "counter overflow"), (None, None), (None, "value is not an integer"), (None, None), (13, None),
        (None, "value is not an integer"), (None, "value is not an integer"),
    ]


def test_stored_counter_texts():
    assert [folds.parse_counter(t) for t in ["7", " 7", "\t-7", "+7", "7 ", "", "x", "1_0", "٣", None, "9" * 30]] == [7, 7, -7, 7, None, None, None, None, None, None, None]


def test_lists_as_queue_and_stack(spark):
    rows = [("q", i, "RPUSH", i) for i in range(5)] + [("q", 5, "LPOP", None), ("q", 6, "RPOP", None), ("q", 7, "LPUSH", 9)] + [("gone", 8, "LPUSH", 1), ("gone", 9, "RPOP", None), ("gone", 10, "RPOP", None)]
    got = folds.lists(spark.createDataFrame(rows, "key string, pos long, op string, n long")).collect()
    assert [(r.key, r["items"]) for r in got] == [("q", ["9", "1", "2", "3"])]


@pytest.mark.parametrize("capacity", [0, 1, 3])
def test_caches_match_models(spark, capacity):
    draw = random.Random(capacity)
    trace = [("s", i, str(int(draw.paretovariate(0.7)) % 9)) for i in range(300)]
    df = spark.createDataFrame(trace, "shard string, pos long, key string")
    held, lru = OrderedDict(), []
    for _, _, k in trace:
        lru.append(k in held and capacity > 0)
        held[k] = held.pop(k, None)
        if len(held) > capacity:
            held.popitem(last=False)
    assert [r.hit for r in folds.lru_hits(df, capacity).orderBy("pos").collect()] == lru
    used, lfu = {}, []  # key -> (count, when it got that count)
    for t, (_, _, k) in enumerate(trace):
        lfu.append(k in used)
        if k in used:
            used[k] = (used[k][0] + 1, t)
        elif capacity:
            if len(used) == capacity:
                del used[min(used, key=used.get)]
            used[k] = (1, t)
    assert [r.hit for r in folds.lfu_hits(df, capacity).orderBy("pos").collect()] == lfu


def test_hash_replies_and_views(spark):
    rows = [("u", 0, "HSET", "name", "A"), ("u", 1, "HSET", "age", "3"), ("u", 2, "HSET", "name", "B"), ("v", 3, "HSET", "f", "1"), ("v", 4, "HDEL", "f", None), ("v", 5, "HDEL", "f", None)]
    ops = spark.createDataFrame(rows, "key string, pos long, op string, field string, value string")
    assert [r.reply for r in hashes.replies(ops).orderBy("pos").collect()] == [1, 1, 0, 1, 1, 0]
    whole = hashes.hgetall(ops)
    assert [(r.key, [tuple(x) for x in r["items"]]) for r in whole.collect()] == [("u", [("age", "3"), ("name", "B")])]
    assert hashes.hkeys(whole).first().fields == ["age", "name"] and hashes.hvals(whole).first()["values"] == ["3", "B"]
    assert [r.key for r in hashes.emptied(ops).collect()] == ["v"]


def _log(spark, rows):
    return spark.createDataFrame(rows, "key string, seq long, type int, value string, expires_at_ms long")


def test_occ_conflicts_and_reads(spark):
    log = _log(spark, [("x", 1, 0, "base", 0), ("x", 5, 0, "new", 0), ("d", 2, 0, "v", 0), ("d", 3, 1, None, 0)])
    keys = spark.createDataFrame([(1, 1, "x"), (1, 1, "y"), (2, 5, "x"), (3, 9, "zzz")], "txn long, start_seq long, key string")
    assert {r.txn: r.conflict for r in txn.conflicts(log, keys).collect()} == {1: True, 2: False, 3: False}
    reads = spark.createDataFrame([(1, "x", 1), (1, "d", 2), (2, "d", 3), (2, "x", 9), (3, "x", 9), (4, "none", 9)], "txn long, key string, start_seq long")
    own = spark.createDataFrame([(2, 0, "PUT", "x", "a"), (2, 1, "PUT", "x", "mine"), (3, 0, "DEL", "x", None)], "txn long, pos long, op string, key string, value string")
    got = {(r.txn, r.key): (r.value, r.tracked) for r in txn.read(log, reads, own, 0).collect()}
    assert got == {(1, "x"): ("base", True), (1, "d"): ("v", True), (2, "d"): (None, True), (2, "x"): ("mine", False), (3, "x"): (None, False), (4, "none"): (None, True)}
    assert [(r.pos, r.value) for r in txn.dedupe_writes(own).where("txn = 2").collect()] == [(0, "mine")]


def test_schedule_lets_losers_write_nothing(spark):
    rows = [("p", 0, 1, 0, ["a"]), ("p", 1, 2, 0, ["a"]), ("p", 2, 3, 1, ["a", "b"]), ("p", 3, 4, 2, ["b"])]
    ops = spark.createDataFrame(rows, "part string, pos long, txn long, start_seq long, keys array<string>")
    assert {r.txn: r.committed for r in txn.schedule(ops).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_pessimistic_and_locks(spark):
    rows = [("p", 0, 1, "PUT", "a", "1"), ("p", 1, 2, "PUT", "a", "2"), ("p", 2, 2, "GET", "a", None), ("p", 3, 1, "GET", "a", None), ("p", 4, 1, "COMMIT", None, None), ("p", 5, 2, "PUT", "a", "2"), ("p", 6, 2, "ROLLBACK", None, None), ("p", 7, 3, "GET", "a", None)]
    got = txn.pessimistic(spark.createDataFrame(rows, "part string, pos long, txn long, op string, key string, value string")).orderBy("pos").collect()
    assert [(r.reply, r.error) for r in got] == [("OK", None), (None, "write conflict"), (None, None), ("1", None), ("OK", None), ("OK", None), ("OK", None), ("1", None)]
    trace = [("k", 0, 1, "S"), ("k", 1, 2, "S"), ("k", 2, 1, "X"), ("k", 3, 2, "UNLOCK"), ("k", 4, 1, "X"), ("k", 5, 1, "S"), ("k", 6, 2, "S"), ("k", 7, 1, "UNLOCK"), ("k", 8, 2, "X"), ("k", 9, 0, "S"), ("k", 10, 3, "UNLOCK")]
    got = txn.locks(spark.createDataFrame(trace, "key string, pos long, owner long, op string")).orderBy("pos").collect()
    assert [r.granted for r in got] == [True, True, False, True, True, True, False, True, True, False, False]
