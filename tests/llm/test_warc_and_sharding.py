import hashlib

import duckdb
import pytest
import zstandard

from verlog.llm import queries, sharding, warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, error string")


BIG = "<p>" + "grün 😀" * 300


@pytest.fixture(scope="module")
def rows():
    return [(1, "http://a/\r\nX: y%", BIG), (2, None, BIG), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", BIG + "z"), (9, "u", BIG), (9, "u", BIG), (None, "u", "n")]


def test_round_trip_by_both_joins(spark, rows, tmp_path):
    for few in (0, 1000):
        plan = warc.plan_records(pages(spark, rows), broadcast_rows=few)
        folder = f"file://{tmp_path}/{few}"
        assert warc.write_archives(plan, folder, archive_bytes=3000) == len(rows)
        got = warc.read_archives(spark, folder).collect()
        assert all(r.error is None for r in got) and len(got) == len(rows)
        by = {r.page_id: r for r in got}
        for page, url, html in rows:
            body = (html or "").encode()
            r = by[page]
            assert r.payload_bytes == len(body) and r.payload_digest == hashlib.sha1(body).hexdigest() and r.target_uri == url
            revisit = page in (1, 2)
            assert r.record_type == ("revisit" if revisit else "response") and r.refers_to == (9 if revisit else None)
            assert bytes(r.payload) == (b"" if revisit else body)


def test_empty_table(spark, tmp_path):
    assert warc.round_trip(pages(spark, [])).count() == 0


def records(n=40):
    bodies = [f"<html>{i} ".encode() * 50 for i in range(n)]
    return [warc.encode_record(i, f"u{i}", b, hashlib.sha1(b).hexdigest(), None, "2024-01-01T00:00:00Z") for i, b in enumerate(bodies)], bodies


def archive(with_dictionary, compressed=False):
    recs, bodies = records()
    trained = warc.train_dictionary(bodies) if with_dictionary else b""
    z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    stored = zstandard.ZstdCompressor().compress(trained) if compressed else trained
    lead = warc.SKIPPABLE + len(stored).to_bytes(4, "little") + stored if trained else b""
    return lead + b"".join(z.compress(r) for r in recs)


@pytest.mark.parametrize("kind", [(False, False), (True, False), (True, True)])
def test_archives_with_and_without_dictionary(kind):
    data = archive(*kind)
    assert (data[:4] == warc.SKIPPABLE) == kind[0]
    got = list(warc.iterate_archive(data))
    assert [r["page_id"] for r in got] == list(range(40)) and all(r["error"] is None for r in got)


def test_damage_is_told():
    data = archive(True)
    cut = list(warc.iterate_archive(data[:-3]))
    assert len(cut) == 40 and "cut" in cut[-1]["error"] and all(r["error"] is None for r in cut[:-1])
    for change in (lambda r: r.replace(b"Content-Length: ", b"Content-Length: 9"), lambda r: r.replace(b"WARC/1.1", b"MIME/1.0"), lambda r: r.replace(b"WARC-Date", b"X-Date"), lambda r: r[:-4], lambda r: r.replace(b"</", b"<"), lambda r: r.replace(b"<html>", b"<htmX>")):
        rec = records(1)[0][0]
        if change(rec) != rec:
            with pytest.raises(ValueError):
                warc.parse_record(change(rec))


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    want = sorted(map(repr, con.sql(queries.OP1_SQL).fetchall()))
    assert sorted(repr(tuple(r)) for r in queries.op1_warc(spark, "/root/testdata/sf0.001").collect()) == want


def docs(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, shard int")


def test_sharding_is_whole_gapless_and_near_equal(spark):
    rows = [(i, "word " * (i % 40)) for i in range(600)] + [(1000 + i, f"copy {i % 3} " * 20) for i in range(900)] + [(5000, None), (5001, ""), (5001, ""), (None, "no id")]
    got = sharding.assign_shards(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    load, slots = {}, {}
    for r in got:
        load[r.shard] = load.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(load) == list(range(8)) and max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 8 + 300
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = {r.doc_id: r["size"] for r in got}
    assert sizes[5000] == 1 and sizes[39] == len("word " * 39) + 1 and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_small_groups_stay_together(spark):
    rows = [(i, f"text {i // 3} " + "x" * (i // 3 % 50)) for i in range(1500)]
    where = {}
    for r in sharding.assign_shards(docs(spark, rows)).collect():
        where.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_sharding_of_nothing_and_of_one(spark):
    assert sharding.assign_shards(docs(spark, [])).count() == 0
    assert [(r.shard, r.slot) for r in sharding.assign_shards(docs(spark, [(1, "a")])).collect()][0][1] == 0


def test_sharding_columns_by_hand(spark):
    import zlib

    texts = ["é😀", "", None, "a" * 50_000, "b" * 400_000, *(f"w{i % 7}" for i in range(40)), *(f"grün {i}" for i in range(60))]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, shard int, slot int, `rng` string")
    got = {r.doc_id: r for r in sharding.assign_shards(df).collect()}
    assert got.keys() == dict(rows).keys()
    for i, t in rows:
        body = (t or "").encode()
        assert (got[i]["size"], got[i].text_crc32) == (len(body) + 1, zlib.crc32(body))
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", set()).add(got[i].shard)
    assert all(len(s) == 1 for s in groups.values())  # ties and copies stay together
    # the text that is larger than a shard is alone in its shard, the rest is as near equal as the next one allows
    load = {k: sum(r["size"] for r in got.values() if r.shard == k) for k in {r.shard for r in got.values()}}
    alone = got[4].shard
    assert load[alone] == 400_001
    for k in load:
        slots = sorted(r.slot for r in got.values() if r.shard == k)
        assert slots == list(range(len(slots)))


def test_overfull_ranges_are_cut_until_none_is_left(spark, monkeypatch):
    # a sample that sees next to nothing at first leaves one range with nearly all rows
    rows = [(i, f"text {i}") for i in range(4000)]
    seen = []
    sample = sharding._sample
    monkeypatch.setattr(sharding, "_sample", lambda df, total, n: seen.append(n) or sample(df, total, n)[: 3 if len(seen) < 6 else None])
    got = sharding.assign_shards(docs(spark, rows), ranges_per_shard=16).collect()
    load = {}
    for r in got:
        load[r.shard] = load.get(r.shard, 0) + r["size"]
    assert len(seen) > 5 and len(got) == 4000 and max(load.values()) - min(load.values()) < 0.1 * max(load.values())


def test_long_payloads_and_repeated_pages(spark, tmp_path):
    huge = "<p>" + "x é " * 700_000
    rows = [(1, "u", huge), (2, "u", huge), (2, "u", huge), (3, "u", "z" * 1000), (3, "u", "z" * 1000), (4, "u", "z" * 999), (5, "u", "z" * 999)]
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.round_trip(pages(spark, rows)).collect())
    n = len(huge.encode())
    assert got == [(1, n, "revisit", 2), (2, n, "response", 0), (2, n, "response", 0), (3, 1000, "response", 0), (3, 1000, "response", 0), (4, 999, "response", 0), (5, 999, "response", 0)]
