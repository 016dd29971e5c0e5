import bisect

import pytest
from pyspark.sql import functions as F

from verlog.functions import collections as C
from verlog.operators import hashes, ring, storage, visible
from verlog.functions.ring import Node, Ring
from verlog.sources import fixtures, manifest, wal


def fnv(text: str) -> int:
    h = 1469598103934665603
    for b in text.encode():
        h = (h ^ b) * 1099511628211 % 2**64
    return h


def model_ring(virtual=8):
    return sorted((fnv(f"{n[0]}#{i}"), n[0]) for n in fixtures.NODES if n[4] for i in range(max(1, n[3]) * virtual))


def test_hash_and_routes_match_a_ring_in_python(spark):
    keys = ["", "a", "cust:1", "é中😀", *(f"k{i}" for i in range(200))]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "pos long, key string")
    tokens = model_ring()
    got = {r.key: (int(r.hash), r.node) for r in ring.route(df, fixtures.nodes(spark)).collect()}
    for k in keys:
        at = bisect.bisect_left(tokens, (fnv(k), ""))
        assert got[k] == (fnv(k), tokens[at % len(tokens)][1])
    reps = {}
    for r in ring.replicas(df, fixtures.nodes(spark), 9).collect():
        reps.setdefault(r.key, {})[r["rank"]] = r.node
    for k in keys:
        at = bisect.bisect_left(tokens, (fnv(k), ""))
        want = list(dict.fromkeys(t[1] for t in tokens[at:] + tokens[:at]))
        assert [reps[k][i] for i in range(len(reps[k]))] == want


def test_dead_nodes_and_empty_rings(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "pos long, key string")
    nodes = fixtures.nodes(spark)
    assert {r.node for r in ring.route(df, nodes.withColumn("alive", F.col("id") == "n1")).collect()} == {"n1"}
    assert {r.node for r in ring.route(df, nodes.withColumn("alive", F.lit(False))).collect()} == {None}
    assert ring.tokens(nodes.withColumn("weight", F.lit(0)), 3).count() == 9


def test_batch_plan_keeps_first_seen_order(spark):
    df = spark.createDataFrame([(i, f"k{i % 7}") for i in range(30)], "pos long, key string")
    got = ring.plan(df, fixtures.nodes(spark)).orderBy("grp", "nth").collect()
    firsts = [r.pos for r in got if r.nth == 0]
    assert firsts == sorted(firsts) and len(got) == 30
    assert all(a.pos < b.pos for a, b in zip(got, got[1:]) if a.grp == b.grp)


@pytest.mark.parametrize("start,stop,want", [(1, 3, "bcd"), (-3, -1, "cde"), (0, -1, "abcde"), (10, 20, ""), (-20, -10, ""), (-20, -5, "a"), (3, 1, ""), (0, -6, "")])
def test_lrange(spark, start, stop, want):
    df = spark.createDataFrame([(list("abcde"),)], "items array<string>")
    assert "".join(df.select(C.lrange(F.col("items"), start, stop).alias("x")).first().x) == want


def test_lindex_and_llen(spark):
    df = spark.createDataFrame([(list("abc"),), ([],), (None,)], "items array<string>")
    i = F.col("items")
    got = df.select(C.lindex(i, 0).alias("a"), C.lindex(i, -1).alias("b"), C.lindex(i, 3).alias("c"), C.lindex(i, -4).alias("d"), C.llen(i).alias("n")).collect()
    assert [tuple(r) for r in got] == [("a", "c", None, None, 3), (None, None, None, None, 0), (None, None, None, None, 0)]


def test_files_pick_and_prune(spark):
    rows = [(1, 0, "a", "f"), (2, 0, "k", "m"), (3, 1, "e", "g"), (4, 1, "n", "z"), (5, 1, "", "")]
    files = spark.createDataFrame([(n, lv, lo, hi, 10 * n, 5, 100) for n, lv, lo, hi in rows], "file_number long, level int, smallest string, largest string, max_seq long, n_entries long, bytes long")
    assert sorted(r.file_number for r in storage.pick(files).collect()) == [1, 2, 3, 5]
    assert storage.pick(files.where("file_number = 1")).count() == 0
    assert storage.due(files).first().due == "L0" and storage.due(files.where("level = 1"), budget=300).first().due == "L1"
    asked = spark.createDataFrame([(0, "f"), (1, "zz")], "pos long, key string")
    assert [(r.pruned, r.read) for r in storage.prune_stats(files.where("file_number < 5"), asked).orderBy("pos").collect()] == [(2, 2), (4, 0)]
    assert [(r.pruned, r.read) for r in storage.prune_stats(files, asked).orderBy("pos").collect()] == [(2, 3), (4, 1)]  # one has no bounds


def test_manifest(spark):
    m = spark.createDataFrame([(0, "add", 7), (1, "add", 3), (2, "remove", 7), (3, "add", 9), (4, "add", 7)], "pos long, action string, file_number long")
    assert [r.file_number for r in storage.live_files(m).collect()] == [7, 3, 9]


def test_committed_prefix_stops_at_gaps(spark):
    e = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (2, 2, "B"), (4, 2, "d")], "idx long, term long, data string")
    assert sorted((r.idx, r.data) for r in storage.committed_prefix(e, 10).collect()) == [(1, "a"), (2, "B")]
    assert storage.committed_prefix(e, 10, applied=2).count() == 0
    match = spark.createDataFrame([("a", 4), ("b", 2), ("c", 1)], "node string, match_index long")
    assert storage.commit_index(match, e, 2).first()[0] == 2 and storage.commit_index(match, e, 3).first()[0] == 0


def test_runs_checkpoints_and_reopening(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i % 10}", i + 1, 0, "v", 0) for i in range(100)], "key string, seq long, type int, value string, expires_at_ms long")
    storage.write_run(df.where("seq <= 60"), f"{tmp_path}/a", files=3)
    storage.create_checkpoint(df.where("seq > 40"), f"{tmp_path}/b")
    with pytest.raises(Exception):
        storage.create_checkpoint(df, f"{tmp_path}/b")
    log, following = storage.open_log(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    assert log.count() == 100 and following == 101


def test_wal_round_trip_and_damage(spark, tmp_path):
    rows = [(b"a", 1, 0, b"x", 0), (b"b", 2, 1, None, 0), (b"\xff\x00", 3, 0, b"", 0), (b"d", 4, 0, b"y" * 1000, 77)]
    data = b"".join(wal.encode(*r) for r in rows)
    assert [r[:5] for r in wal.decode(data)] == rows
    for cut in range(len(data)):  # a cut tail ends the file before the record
        got = list(wal.decode(data[:cut]))
        assert all(r[5] is None for r in got) and [r[:5] for r in got] == rows[: len(got)]
    for at in range(30):
        bad = bytearray(data)
        bad[at] ^= 1
        got = list(wal.decode(bytes(bad)))
        assert [r[:5] for r in got if r[5] is None] != rows
    (tmp_path / "1.wal").write_bytes(data)
    (tmp_path / "2.wal").write_bytes(data[:-1] + b"z" + data)
    assert wal.read(spark, str(tmp_path), strict=False).where("fault is null").count() == 4 + 3
    assert wal.read(spark, str(tmp_path), strict=False).where("fault like '%checksum%'").count() == 1
    with pytest.raises(Exception, match="checksum"):
        wal.read(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError):
        wal.encode(b"k", 0, 0, b"v")
    with pytest.raises(ValueError):
        wal.encode(b"k", 1, 1, b"v")


def test_spans_cover_the_ring_and_tokens_that_are_taken_move_up(spark, monkeypatch):
    import random

    from verlog.functions import ring as plain

    r = Ring([Node(*n) for n in fixtures.NODES], 8)
    draw = random.Random(2)
    spans = r.spans(2)
    for h in [0, plain.WRAP, *r.tokens, *(t + 1 for t in r.tokens), *(draw.getrandbits(64) for _ in range(500))]:
        own = [s for s in spans if s[0] == h >> 52 and s[1] <= h <= s[2]]
        assert len(own) == 1 and own[0][3] == r.walk(bisect.bisect_left(r.tokens, h), 2)
    assert Ring([]).spans(1) == [] and Ring([]).route("a") == []
    monkeypatch.setattr(plain, "fnv", lambda text: plain.WRAP)  # all tokens fall on one number
    crowded = Ring([Node("a", "h", 1), Node("b", "h", 1)], 2)
    assert crowded.tokens == [0, 1, 2, plain.WRAP] and [t for *_, t in crowded.rows] == [plain.WRAP, 0, 1, 2]


def test_a_store_keeps_its_content_when_a_commit_fails(spark, tmp_path):
    log = lambda rows: spark.createDataFrame(rows, storage.LOG)
    store = storage.Store(spark, f"file://{tmp_path}/s")
    assert store.read().count() == 0 and store.current is None
    first = store.commit(log([("a", 1, 0, "x", 0), ("a", 2, 1, None, 0), ("b", 3, 0, "y", 0)]))
    for bad in (lambda: store.commit(log([("", 1, 0, "x", 0)])), lambda: store.install(f"file://{tmp_path}/none"), lambda: store.commit(log([("z", 1, 0, "x", 0)]), expected="v-other"),
                lambda: store.compact(0, active_snapshots=1)):
        with pytest.raises(Exception):
            bad()
        assert store.current == first and store.versions() == [first] and store.read().count() == 3
    store.checkpoint(f"file://{tmp_path}/kept")
    second = store.compact(0)
    assert [r.key for r in store.read().collect()] == ["b"] and sorted(store.versions()) == sorted([first, second])
    with pytest.raises(LookupError):
        store.compact(0)
    assert store.vacuum() == [first] and store.versions() == [second]
    store.install(f"file://{tmp_path}/kept")
    assert store.read().count() == 3
    assert storage.install_checkpoint(spark, f"file://{tmp_path}/kept", f"file://{tmp_path}/new").count() == 3


def test_manifest_codec_and_damage(spark, tmp_path):
    records = [manifest.add(7, 70, "f7", 0, 10, b"a", b"c"), manifest.add(3, 30, "f3"), manifest.remove(7), manifest.add(9, 90, "f9", 2, 5, b"", b""), manifest.add(7, 71, "f7b", 1, 9, b"a", b"a")]
    data = b"".join(records)
    ends = [sum(map(len, records[:k])) for k in range(len(records) + 1)]
    for cut in range(len(data) + 1):
        got = list(manifest.decode(data[:cut]))
        assert all(r[-1] is None for r in got) and len(got) == max(k for k, e in enumerate(ends) if e <= cut)
    for at in range(len(data)):
        bad = bytearray(data)
        bad[at] ^= 1
        assert [r for r in manifest.decode(bytes(bad)) if r[-1] is None] != list(manifest.decode(data))
    (tmp_path / "MANIFEST").write_bytes(data[:-2])
    assert [r.file_number for r in storage.live_files(manifest.read(spark, str(tmp_path))).collect()] == [3, 9]
    for wrong in (lambda: manifest.add(0, 1, "x"), lambda: manifest.add(1, 1, ""), lambda: manifest.add(1, 1, "x", smallest=b"a"), lambda: manifest.add(1, 1, "x", smallest=b"b", largest=b"a"), lambda: manifest.remove(0)):
        with pytest.raises(ValueError):
            wrong()


def brute_log(appends):
    log = {}
    for _, idx, term, data in sorted(appends):
        if idx in log and log[idx][0] == term:
            continue
        if idx in log:
            log = {i: e for i, e in log.items() if i < idx}
        log[idx] = (term, data)
    return sorted((i, *e) for i, e in log.items())


@pytest.mark.parametrize("width", [1, 4, 1 << 16])
def test_conflicts_cut_the_log_as_one_by_one(spark, width):
    import random

    draw = random.Random(width)
    appends, last, term = [], 0, 1
    for pos in range(300):
        if last and draw.random() < 0.15:
            term += 1
            last = draw.randint(max(0, last - 12), last - 1)
        last += 1
        appends.append((pos * 10, last, term, f"d{pos}"))
        if draw.random() < 0.2:
            appends.append((pos * 10 + 3, last, term, f"d{pos}"))  # sent twice
    df = spark.createDataFrame(appends, "pos long, idx long, term long, data string").repartition(3)
    assert sorted(map(tuple, storage.truncate_conflicts(df, width).collect())) == brute_log(appends)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reads_of_a_run_reach_the_files(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i:04d}", i + 1, 0, "v", 0) for i in range(1000)], storage.LOG)
    storage.write_run(df, f"{tmp_path}/run", files=4)
    run = spark.read.schema(storage.LOG).parquet(f"{tmp_path}/run")
    assert "EqualTo(key,k0007)" in plan_of(visible.get(run, "k0007", 5)) and visible.get(run, "k0007", 5).count() == 1
    scanned = plan_of(visible.scan(run, 5, "k0100", "k0200"))
    assert "GreaterThanOrEqual(key,k0100)" in scanned and "LessThan(key,k0200)" in scanned
    # disjoint key ranges: one file holds the key
    assert len({r.f for r in run.where("key = 'k0007'").select(F.input_file_name().alias("f")).distinct().collect()}) == 1


def test_no_nested_loop_joins_on_the_ring(spark):
    df = spark.createDataFrame([(0, "a")], "pos long, key string")
    assert "NestedLoop" not in plan_of(ring.route(df, fixtures.nodes(spark))) and "Cartesian" not in plan_of(ring.replicas(df, fixtures.nodes(spark), 2))


def test_planted_failures_leave_nothing_half_done(spark, tmp_path):
    import os

    from verlog import faults

    log = lambda n: spark.createDataFrame([(f"k{i}", i + 1, 0, "v", 0) for i in range(n)], storage.LOG)
    store = storage.Store(spark, f"file://{tmp_path}/s")
    first = store.commit(log(5))
    for point in ("store.write", "store.written", "store.checked", "store.swap"):
        with faults.armed(point), pytest.raises(faults.Planted):
            store.commit(log(9))
        assert store.current == first and store.read().count() == 5
    left = [v for v in store.versions() if v != first]
    assert len(left) == 1  # of the one that died before the swap
    with faults.armed("vacuum.delete"), pytest.raises(faults.Planted):
        store.vacuum()
    assert store.vacuum() == left and store.read().count() == 5
    for point in ("checkpoint.write", "checkpoint.written"):
        with faults.armed(point), pytest.raises(faults.Planted):
            store.checkpoint(f"file://{tmp_path}/c")
        assert not [n for n in os.listdir(tmp_path) if n.startswith("c")]
    store.checkpoint(f"file://{tmp_path}/c")
    assert spark.read.parquet(f"file://{tmp_path}/c").count() == 5
    with pytest.raises(FileExistsError):
        store.checkpoint(f"file://{tmp_path}/c")
    with pytest.raises(ValueError), faults.armed("nowhere"):
        pass
