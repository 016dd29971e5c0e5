"""python -m verlog.cli FOLDER COMMAND …: a store from the command line.

put KEY VALUE [TTL_MS] · delete KEY · get KEY · scan [START [END [LIMIT]]] · ttl KEY · status · stats · list-files · versions ·
compact · checkpoint PATH · install PATH · vacuum
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import storage, visible, writes


def main(args: list[str], spark: SparkSession | None = None, now_ms: int | None = None) -> list[str]:
    """The lines that a command prints."""
    if len(args) < 2:
        raise SystemExit(__doc__)
    spark = spark or SparkSession.builder.appName("verlog").getOrCreate()
    now = now_ms if now_ms is not None else int(time.time() * 1000)
    store, command, rest = storage.Store(spark, args[0]), args[1], args[2:]
    log = store.read()

    def one(df, *columns) -> list[str]:
        return ["\t".join("" if v is None else str(v) for v in row) for row in df.select(*columns).collect()]

    if command in ("put", "delete"):
        before, seq = store.current, visible.snapshot_seq(log) + 1
        row = writes.put(spark, rest[0], rest[1], seq, int(rest[2]) if len(rest) > 2 else 0, now) if command == "put" else writes.delete(spark, rest[0], seq)
        store.commit(storage.merge(log, row), before)
        return [str(seq)]
    if command == "get":
        return one(visible.get(log, rest[0], now), "value") or ["(none)"]
    if command == "scan":
        return one(visible.scan(log, now, *rest[:2], limit=int(rest[2]) if len(rest) > 2 else 0), "key", "value")
    if command == "ttl":
        return one(visible.pttl(log, spark.createDataFrame([(0, rest[0])], "pos long, key string"), now), "pttl_ms")
    if command == "status":
        return [f"current={store.current}", f"versions={len(store.versions())}", f"next_seq={visible.snapshot_seq(log) + 1}"]
    if command == "stats":
        row = log.agg(F.count("*"), F.countDistinct("key"), F.count_if(F.col("type") == 1)).first()
        return [f"rows={row[0]}", f"keys={row[1]}", f"deletions={row[2]}", f"live={visible.live(log, now).count()}"]
    if command == "list-files":
        files = log.groupBy(F.input_file_name().alias("file")).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("rows"))
        return one(files.orderBy("low"), "file", F.lower(F.hex("low")), F.lower(F.hex("high")), "rows")
    if command == "versions":
        return store.versions()
    if command == "compact":
        return [store.maybe_compact(now) or "nothing to compact"]
    if command == "checkpoint":
        store.checkpoint(rest[0])
        return [rest[0]]
    if command == "install":
        return [store.install(rest[0])]
    if command == "vacuum":
        return store.vacuum()
    raise SystemExit(__doc__)


if __name__ == "__main__":
    print("\n".join(main(sys.argv[1:])))
