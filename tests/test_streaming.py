from verlog.schema import LOG
from verlog.streaming import claims, ingest


def test_ingest_appends_each_file_once(spark, tmp_path):
    rows = [(f"k{i}", i + 1, 0, "v", 0) for i in range(20)]
    source, log, marks = (f"{tmp_path}/{x}" for x in ("in", "log", "marks"))
    spark.createDataFrame([*rows, ("", 99, 0, "v", 0)], LOG).repartition(3).write.parquet(source)
    ingest.follow(spark, source, log, marks, files_per_batch=2).awaitTermination()
    ingest.follow(spark, source, log, marks).awaitTermination()
    assert ingest.read_log(spark, log).count() == 20
    assert spark.read.parquet(f"{log}-faulty").count() == 1


def test_streamed_claims(spark, tmp_path):
    rows = [("a", 0, 0, 100), ("a", 1, 50, 100), ("a", 2, 100, 100), ("b", 3, 5, 0), ("b", 4, 10**6, 9)]
    df = spark.createDataFrame(rows, "key string, pos long, ts_ms long, ttl_ms long")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = claims.claims(stream).writeStream.format("memory").queryName("taken").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.key, r.pos, r.expires_at_ms) for r in spark.table("taken").collect()) == [("a", 0, 100), ("a", 2, 200), ("b", 3, 0)]


def test_expired_claims_leave_the_state(spark, tmp_path):
    day = 86_400_000
    schema = "key string, pos long, ts_ms long, ttl_ms long"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    held = []
    for k, rows in enumerate(([("a", 0, day, 100), ("b", 1, day, 0)], [("c", 2, 9 * day, 100)], [("c", 3, 19 * day, 100)], [("d", 4, 29 * day, 100)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = claims.claims(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert held[0] == 2 and max(held) <= 3 and held[-1] <= 3  # b stays for good; a and the first c are gone
    assert sorted(r.pos for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2, 3, 4]
