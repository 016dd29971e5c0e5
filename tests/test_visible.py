import random

import pytest

from verlog.operators import storage, visible, writes
from verlog.operators.visible import live, scan
from verlog.schema import LOG, split_faulty

NOW = 1_000


def log(spark, rows):
    return spark.createDataFrame([(k, s, t, v, e) for k, s, t, v, e in rows], LOG)


def pairs(df):
    return [(r.key, r.value) for r in df.collect()]


class Model:
    """A dict of version lists."""

    def __init__(self):
        self.rows = []

    def add(self, key, kind, value, expires):
        self.rows.append((key, len(self.rows) + 1, kind, value, expires))

    def live(self, now, upto):
        newest = {}
        for r in self.rows:
            if r[1] <= upto:
                newest[r[0]] = r
        return sorted((k, r[3]) for k, r in newest.items() if r[2] == 0 and not 0 < r[4] <= now)


def test_newest_version_decides_even_if_dead(spark):
    df = log(spark, [("a", 1, 0, "old", 0), ("a", 2, 1, None, 0), ("b", 3, 0, "old", 0), ("b", 4, 0, "new", NOW), ("c", 5, 0, "x", NOW + 1)])
    assert pairs(live(df, NOW)) == [("c", "x")]
    assert pairs(live(df, NOW, upto=3)) == [("b", "old")]
    assert sorted(pairs(live(df, NOW, upto=1))) == [("a", "old")]


def test_range_scan_and_limit(spark):
    df = log(spark, [("a", 1, 0, "1", 0), ("b", 2, 0, "2", 0), ("c", 3, 0, "3", 0), ("b", 4, 1, None, 0)])
    assert pairs(scan(df, NOW, "a", "c")) == [("a", "1")]
    assert pairs(scan(df, NOW, limit=1)) == [("a", "1")]
    assert pairs(visible.seek(df, "b", NOW)) == [("c", "3")]
    assert [(r.key, r.item, r.text) for r in visible.scan_reply(scan(df, NOW, "c")).collect()] == [("c", 0, "c"), ("c", 1, "3")]


def test_mget_keeps_positions_and_duplicates(spark):
    df = log(spark, [("k1", 1, 0, "v1", 0), ("k3", 2, 0, "v3", 0)])
    asked = spark.createDataFrame([(0, "k1"), (1, "k2"), (2, "k3"), (3, "k1")], "pos long, key string")
    assert [r.value for r in visible.mget(df, asked, NOW).orderBy("pos").collect()] == ["v1", None, "v3", "v1"]
    assert [r.present for r in visible.exists(df, asked, NOW).orderBy("pos").collect()] == [True, False, True, True]


def test_ttl_floors_and_sentinels(spark):
    df = log(spark, [("a", 1, 0, "x", NOW + 999), ("b", 2, 0, "x", 0), ("c", 3, 0, "x", NOW)])
    asked = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d")], "pos long, key string")
    got = visible.pttl(df, asked, NOW).orderBy("pos").collect()
    assert [(r.pttl_ms, r.ttl_s) for r in got] == [(999, 0), (-1, -1), (-2, -2), (-2, -2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_logs_match_a_model(spark, seed):
    draw, model = random.Random(seed), Model()
    for _ in range(400):
        kind = draw.random() < 0.2
        model.add(f"k{draw.randint(0, 30)}", int(kind), None if kind else str(draw.random()), 0 if kind else draw.choice([0, 0, 500, NOW, NOW + 5]))
    df = log(spark, random.Random(seed).sample(model.rows, len(model.rows)))
    for upto in (50, 200, 400):
        want = model.live(NOW, upto)
        assert sorted(pairs(live(df, NOW, upto))) == want
        # neither replay of what is there already nor compaction changes what is seen
        assert sorted(pairs(live(storage.replay(df, df.where("seq > 100")), NOW, upto))) == want
    for level in (1, 2):
        assert sorted(pairs(live(storage.compact(df, level, NOW), NOW))) == model.live(NOW, 400)


def test_faulty_rows_are_split_off(spark):
    raw = spark.createDataFrame([("", 1, 0, "v", 0), ("k", 0, 0, "v", 0), ("k", 1, 1, "v", 0), ("k", 2, 1, None, 5), ("k", 3, 0, "v", 0), (None, 4, 0, "v", 0), ("k", 5, 7, "v", 0)],
                                "key string, seq long, type int, value string, expires_at_ms long")
    sound, faulty = split_faulty(raw)
    assert sound.count() == 1 and faulty.count() == 6


def test_snapshots(spark):
    df = log(spark, [("a", 1, 0, "x", 0), ("a", 7, 0, "y", 0)])
    held = visible.Snapshots()
    s = held.take(df.where("seq < 5"))
    assert pairs(live(df, NOW, held.seq(s))) == [("a", "x")] and held.active == 1
    held.release(s)
    with pytest.raises(ValueError):
        held.release(s)
    with pytest.raises(ValueError):
        held.seq(99)


def test_batch_numbers_and_empty_keys(spark):
    ops = spark.createDataFrame([(5, "PUT", "a", "1"), (70_000, "DEL", "a", None), (200_000, "PUT", "b", "2")], "pos long, op string, key string, value string")
    got = [(r.key, r.seq, r.type, r.value) for r in writes.batch(ops, 10).orderBy("seq").collect()]
    assert got == [("a", 10, 0, "1"), ("a", 11, 1, None), ("b", 12, 0, "2")]
    assert tuple(writes.batch_size(ops).first()) == (3, 3 + 2 + 3)
    with pytest.raises(Exception, match="empty key"):
        writes.batch(ops.selectExpr("pos", "op", "'' as key", "value"), 1).collect()


def test_expire_and_persist(spark):
    df = log(spark, [("a", 1, 0, "x", 0), ("b", 2, 0, "y", NOW + 50)])
    asked = spark.createDataFrame([(0, "a", 2_000), (1, "b", 0), (2, "c", 5)], "pos long, key string, ttl_ms long")
    got = [(r.reply, r.type, r.value, r.expires_at_ms) for r in writes.expire(df, asked, NOW).orderBy("pos").collect()]
    assert got == [(1, 0, "x", NOW + 2_000), (1, 1, None, 0), (0, None, None, None)]
    got = [(r.reply, r.writes) for r in writes.persist(df, asked.select("pos", "key"), NOW).orderBy("pos").collect()]
    assert got == [(1, False), (1, True), (0, False)]
    with pytest.raises(ValueError):
        writes.put(spark, "a", "v", 1, ttl_ms=-1)
    assert writes.put(spark, "a", "v", 1, ttl_ms=5, now_ms=NOW).first().expires_at_ms == NOW + 5
    assert writes.delete(spark, "a", 1).first().type == 1


def test_numbers_of_sparse_positions(spark):
    from verlog.operators import writes

    places = [0, 3, 4, 10**6, 10**15, 10**15 + 1, -5, 2**40, 2**40 + 7]
    df = spark.createDataFrame([(p,) for p in places], "pos long").repartition(3)
    got = {r.pos: r.seq for r in writes.number(df, start=10).collect()}
    assert got == {p: 10 + k for k, p in enumerate(sorted(places))}
    assert writes.number(df.limit(0)).count() == 0
