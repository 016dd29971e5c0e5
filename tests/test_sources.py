import re

import pytest

from verlog import config
from verlog.operators import bloom, storage
from verlog.plans import catalogue
from verlog.schema import LOG
from verlog.sources import resp, wal


def test_requests_round_trip_and_faults(spark, tmp_path):
    asked = [[b"SET", b"k\r\n", b"\x00\xff"], [b"PING"], []]
    data = b"".join(map(resp.encode, asked)) + b"get  a\r\n" + b"x\n"
    assert [a for a, _ in resp.decode(data)] == [*asked, [b"get", b"a"], [b"x"]]
    for cut in range(len(data)):
        assert all(f is None for _, f in resp.decode(data[:cut]))
    for bad, why in [(b"*x\r\n", "array length"), (b"*-1\r\n", "array length"), (b"*9999\r\n", "too many"), (b"*1\r\n+a\r\n", "expected"), (b"*1\r\n$-1\r\n", "bulk string length"), (b"*1\r\n$99999999\r\n", "too large"), (b"*1\r\n$1\r\nab\r\n", "terminator")]:
        assert why in list(resp.decode(bad))[-1][1]
    (tmp_path / "a.resp").write_bytes(data)
    got = resp.read(spark, str(tmp_path)).orderBy("nth").collect()
    assert [r.args for r in got][1:] == [["PING"], [], ["get", "a"], ["x"]]


def test_segments_round_trip(spark, tmp_path):
    rows = [(f"k{i % 7}", i, int(i % 5 == 0), None if i % 5 == 0 else f"v{i}é", 0 if i % 3 or i % 5 == 0 else 10**12) for i in range(1, 500)]
    files = wal.write_segments(spark.createDataFrame(rows, LOG), f"file://{tmp_path}/wal", segment_bytes=2000).collect()
    assert sum(r.records for r in files) == len(rows) and len(files) > 4 and all(len(r.file) == 24 for r in files)
    back = wal.read(spark, f"{tmp_path}/wal").selectExpr("cast(key as string)", "seq", "type", "cast(value as string)", "expires_at_ms")
    assert sorted(map(tuple, back.collect()), key=lambda r: r[1]) == rows


def test_bloom_has_no_false_negatives(spark):
    df = spark.createDataFrame([(i % 3, f"k{i}") for i in range(3000)], "file_number long, key string")
    filters = bloom.build(df)
    assert bloom.may_contain(filters, df).where("not maybe").count() == 0
    others = df.selectExpr("file_number", "concat(key, '#') as key")
    assert bloom.may_contain(filters, others).where("maybe").count() < 3000 * 0.05


def test_bloom_of_all_files_for_all_keys(spark):
    entries = spark.createDataFrame([(i % 3 if i % 5 else 9, f"k{i % 400}" if i % 7 else None) for i in range(3000)] + [(8, None), (None, "k1"), (None, None)], "file_number long, key string")
    asked = spark.createDataFrame([(f"k{i}",) for i in range(2500)] + [("k1",), (None,), (None,)], "key string")
    pairs = asked.distinct().crossJoin(entries.select("file_number").where("file_number is not null").distinct())
    rows = lambda df: sorted((repr(r.file_number), repr(r.key), r.maybe) for r in df.collect())
    want = sorted(rows(bloom.may_contain(bloom.build(entries), pairs)) + [("None", repr(k), False) for k in {r.key for r in asked.collect()}])
    assert len(want) == 6 * 2501 and sum(w[2] for w in want) > 1000
    for widest in (bloom.WIDEST, 6010, 32):  # no file, some and nearly all are probed word by word
        assert rows(bloom.may_contain_all(entries, asked, widest=widest)) == want
    assert bloom.may_contain_all(entries.limit(0), asked).isEmpty() and bloom.may_contain_all(entries, asked.limit(0)).isEmpty()
    made = bloom.may_contain_all(entries, asked)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in made.split("CartesianProduct")[0]


def test_bloom_probe_shuffles_no_pairs(spark, tmp_path):
    spark.range(5000).selectExpr("id as event_id", "id % 50 as user_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "'view' as event_type", "'' as props").write.parquet(f"{tmp_path}/events.parquet")
    plan = catalogue.queries()["bloom_probe"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    above = re.split("CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert len(above) == 2 and not re.search("Exchange|Aggregate|Sort", above[0])


def test_bloom_probe_of_events_without_numbers(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(None if i % 9 == 0 else i * 3, None if i % 8 == 0 else i % 5) for i in range(600)]
    spark.createDataFrame(rows, "event_id long, user_id long").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' as ts", "'view' as event_type", "1D as value", "'' as props").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(f"SELECT file_number, key, maybe FROM ({catalogue.oracle_sql()['bloom_probe']})").fetchall()
    got = [(r.file_number, r.key, r.maybe) for r in catalogue.queries()["bloom_probe"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(w[0] is None for w in want)


def test_reclaim_waits_for_snapshots(spark):
    df = spark.createDataFrame([("a", 1, 0, "x", 5), ("b", 2, 0, "y", 0), ("c", 3, 1, None, 0)], LOG)
    assert storage.reclaim(df, 5).count() == 1 and storage.reclaim(df, 4).count() == 3 and storage.reclaim(df, 5, active_snapshots=1).count() == 3


def test_checkpoint_install(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0, "x", 5), ("b", 2, 0, "y", 0)], LOG)
    storage.create_checkpoint(df, f"{tmp_path}/c")
    assert storage.install_checkpoint(spark, f"{tmp_path}/c", f"{tmp_path}/log").count() == 2
    df.selectExpr("'' as key", "seq", "type", "value", "expires_at_ms").write.parquet(f"{tmp_path}/bad")
    with pytest.raises(ValueError):
        storage.install_checkpoint(spark, f"{tmp_path}/bad", f"{tmp_path}/never")


def test_applied_commands(spark):
    rows = [(1, "S", "a", "x", 0, 0), (2, "E", "a", None, 50, 10), (3, "E", "a", None, 90, 50), (4, "T", "a", "y", 70, 60), (5, "D", "a", None, 0, 61), (6, "E", "a", None, 99, 62), (7, "N", "a", None, 0, 63)]
    got = storage.apply_commands(spark.createDataFrame(rows, "idx long, op string, key string, value string, expires_at_ms long, ts_ms long")).orderBy("seq").collect()
    assert [(r.seq, r.type, r.value, r.expires_at_ms) for r in got] == [(1, 0, "x", 0), (2, 0, "x", 50), (4, 0, "y", 70), (5, 1, None, 0)]


def test_settings():
    text = "server:\n  requirepass: \"pw\" # secret\nstorage:\n  bloom_bits_per_key: 12\n  auto_compaction_enabled: off\ncache:\n  capacity: 7\n# bloom_bits_per_key: 1\n"
    got = config.load(text, {"KV_BLOOM_BITS_PER_KEY": "20", "OTHER": "1"})
    assert (got.requirepass, got.bloom_bits_per_key, got.auto_compaction_enabled, got.cache_capacity) == ("pw", 20, False, 7)
    assert config.load() == config.Options()
    with pytest.raises(ValueError):
        config.load("storage:\n  auto_compaction_enabled: maybe\n")


def test_executors_get_the_package(spark):
    import zipfile

    from verlog.shipping import ship

    at = ship(spark)
    names = zipfile.ZipFile(at.removeprefix("file://").removeprefix("file:")).namelist()
    assert "verlog/operators/visible.py" in names and "verlog/__init__.py" in names


def test_encodings_and_damage(spark):
    import random

    from pyspark.sql import functions as F

    from verlog.functions import encodings as E

    draw = random.Random(1)
    lists = [[], [""], ["a", "é中", "x" * 300], ["".join(draw.choices("abc\0é", k=draw.randint(0, 9))) for _ in range(50)]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, items array<string>")
    coded = df.select("i", E.encode_list(F.col("items")).alias("data"))
    stored = {r.i: bytes(r.data) for r in coded.collect()}
    for i, x in enumerate(lists):
        assert [p.decode() for p in E.decode_parts(stored[i])] == x
        for cut in range(len(stored[i])):
            assert E.decode_parts(stored[i][:cut]) is None
        assert E.decode_parts(stored[i] + b"z") is None
    assert {r.i: r["items"] for r in E.decode_column(coded, "data").collect()} == dict(enumerate(lists))
    assert E.decode_parts(b"\xff\xff\xff\xff") is None and E.decode_hash(b"") is None
    twice = b"\x02\0\0\0" + b"\x01\0\0\0f\x01\0\0\0a" + b"\x01\0\0\0f\x01\0\0\0b"
    assert E.decode_hash(twice) == {b"f": b"b"}
    values = [("v", 0), ("v", 7), ("", 2**55 + 5), ("KVTTL001", 0), ("KVTTL00112345678", 0), ("KVTTL001" + "\0" * 8 + "x", 0)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, value string, x long")
    data = E.encode_value(F.col("value"), F.col("x"))
    value, expiry = E.decode_value(F.col("data"))
    got = {r.i: (r.v, r.e) for r in df.withColumn("data", data).select("i", value.cast("string").alias("v"), expiry.alias("e")).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 5)] == [values[i] for i in (0, 1, 2, 3, 5)]
    assert got[4][0] == "" and got[4][1] > 0  # a plain value that looks like a marked one is read as one


def test_archives_and_paths(spark, tmp_path):
    from verlog.sources import archive

    files = [("a.txt", b"1"), ("d/e/f", b"\0" * 100), ("empty", b"")]
    data = archive.pack(files)
    assert archive.unpack(data) == files and archive.unpack(archive.pack([])) == []
    for bad in (data[:-1], data + b"x", data[:5], b"X" + data[1:], data.replace(b"d/e/f", b"../ef"), data.replace(b"a.txt", b"/root")):
        with pytest.raises(ValueError):
            archive.unpack(bad)
    for path in ("", "/x", "../x", "a/../../x"):
        with pytest.raises(ValueError):
            archive.pack([(path, b"")])
    (tmp_path / "1.snap").write_bytes(data)
    (tmp_path / "2.snap").write_bytes(data[:-1])
    got = archive.read(spark, str(tmp_path)).collect()
    assert sorted((r.path, bytes(r.content)) for r in got if r.fault is None) == sorted(files) and sum(r.fault is not None for r in got) == 1


def test_the_command_line_keeps_a_store(spark, tmp_path):
    from verlog import cli

    at = f"file://{tmp_path}/s"
    run = lambda *a: cli.main([at, *a], spark, 1000)
    assert run("get", "a") == ["(none)"] and run("put", "a", "1") == ["1"] and run("put", "b", "2", "500") == ["2"] and run("put", "a", "3") == ["3"] and run("delete", "c") == ["4"]
    assert run("get", "a") == ["3"] and run("scan") == ["a\t3", "b\t2"] and run("scan", "b") == ["b\t2"] and run("ttl", "b") == ["500"]
    assert run("stats") == ["rows=4", "keys=3", "deletions=1", "live=2"] and run("status")[1:] == ["versions=4", "next_seq=5"]
    assert run("checkpoint", f"file://{tmp_path}/c") and run("compact")[0].startswith("v-") and run("compact") == ["nothing to compact"]
    assert run("stats")[0] == "rows=2" and len(run("vacuum")) == 4 and len(run("list-files")) >= 1 and len(run("versions")) == 1
    assert run("install", f"file://{tmp_path}/c") and run("stats")[0] == "rows=4"
    with pytest.raises(SystemExit):
        run("nonsense")


def test_commands_and_damage(spark):
    from pyspark.sql import functions as F

    from verlog.functions import encodings as E

    rows = [("S", "ké", "v", 0), ("T", "k", "", 2**40), ("E", "", "", 9), ("D", "key", "", 0), ("N", "", "", 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, op string, key string, value string, x long")
    coded = df.select("i", E.encode_command(F.col("op"), F.col("key"), F.col("value"), F.col("x")).alias("data"))
    assert {r.i: tuple(r.c) for r in coded.withColumn("c", E.decode_command(F.col("data"))).collect()} == {i: (o, k, v if o in "ST" else "", x) for i, (o, k, v, x) in enumerate(rows)}
    damaged = []
    for r in coded.collect():
        damaged += [bytes(r.data[:cut]) for cut in range(len(r.data))] + [bytes(r.data) + b"z", b"X" + bytes(r.data[1:])]
    bad = spark.createDataFrame([(bytearray(b),) for b in damaged], "data binary")
    assert bad.withColumn("c", E.decode_command(F.col("data"))).where("c is not null").count() == 0
    members = spark.createDataFrame([([1, 2**40],)], "m array<long>").select(E.encode_command(F.lit("M"), F.lit(""), F.lit(""), F.lit(0), F.col("m")).alias("d")).first().d
    assert bytes(members) == b"M" + (2).to_bytes(4, "big") + (1).to_bytes(8, "big") + (2**40).to_bytes(8, "big")
