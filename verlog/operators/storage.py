"""Files of a log: flushing, file metadata, compaction, the manifest, recovery and checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Options
from ..faults import reach
from ..schema import LOG, split_faulty
from ..sources import paths
from .folds import stream_fold
from .visible import expired, latest

BOTTOM = 2  # the level at which tombstones and expired values go


def merge(*sources: DataFrame) -> DataFrame:
    """All versions of several sorted runs or logs."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def replay(base: DataFrame, wal: DataFrame) -> DataFrame:
    """Base and log with each version once: a record may be in both after a crash."""
    return merge(base, wal).dropDuplicates(["key", "seq"])


def compact(log: DataFrame, level: int, now_ms: int) -> DataFrame:
    """The newest version of each key; at the bottom level without tombstones and expired values."""
    newest = latest(log)
    return newest.where((F.col("type") == 0) & ~expired(now_ms)) if level >= BOTTOM else newest


def reclaim(log: DataFrame, now_ms: int, active_snapshots: int = 0) -> DataFrame:
    """The log without what has expired or been deleted, if something has expired and no snapshot needs
    it; else the log as it is."""
    if active_snapshots or latest(log).where(expired(now_ms)).isEmpty():
        return log
    return compact(log, BOTTOM, now_ms)


def write_run(log: DataFrame, path: str, files: int | None = None, records_per_file: int = 0) -> None:
    """Write one sorted run: files cover disjoint key ranges, so scans skip them by their statistics; a
    bloom filter on key serves point reads."""
    ranged = log.repartitionByRange(files, "key") if files else log.repartitionByRange("key")
    ranged.sortWithinPartitions("key", F.desc("seq")).write.option("parquet.bloom.filter.enabled#key", "true").option("maxRecordsPerFile", records_per_file).parquet(path)


def metadata(log: DataFrame, file_number, level: int = 0) -> DataFrame:
    """A row for each file: its number, level, key range, greatest sequence number, rows and bytes."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return log.groupBy(file_number.alias("file_number")).agg(
        F.lit(level).alias("level"), F.min("key").alias("smallest"), F.max("key").alias("largest"), F.max("seq").alias("max_seq"),
        F.count("*").alias("n_entries"), F.sum(size).cast("long").alias("bytes"),
    )


def overlaps(smallest, largest, low, high):
    """Whether a file may hold keys of a range; unknown bounds (empty) may."""
    return (smallest == "") | (largest == "") | ~((largest < low) | (smallest > high))


def pick(files: DataFrame, min_files: int = Options.compaction_min_input_files) -> DataFrame:
    """The inputs of the next compaction: all files of level 0 (of level 1 if 0 has none), and those of
    the next level whose range overlaps theirs. Nothing if they are too few."""
    at = files.where("level < 2").agg(F.min("level").alias("from_level"))
    upper = files.join(F.broadcast(at), F.col("level") == F.col("from_level")).drop("from_level")
    span = upper.agg(F.min("smallest").alias("low"), F.max("largest").alias("high"), F.min("level").alias("l"), F.count("*").alias("n")).where(F.col("n") >= min_files)
    chosen = files.crossJoin(F.broadcast(span))  # one row
    lower = (F.col("level") == F.col("l") + 1) & overlaps(F.col("smallest"), F.col("largest"), F.col("low"), F.col("high"))
    return chosen.where((F.col("level") == F.col("l")) | lower).select(*files.columns)


def due(files: DataFrame, min_files: int = Options.compaction_min_input_files, budget: int = Options.compaction_level_max_bytes) -> DataFrame:
    """Which automatic compaction is due: 'L0', 'L1' or null, from counts and bytes by level."""
    by = files.agg(F.count_if(F.col("level") == 0).alias("n0"), F.count_if(F.col("level") == 1).alias("n1"), F.coalesce(F.sum(F.when(F.col("level") == 1, F.col("bytes"))), F.lit(0)).alias("b1"))
    return by.select("n0", "n1", "b1", F.when(F.col("n0") >= min_files, "L0").when((F.col("n1") >= min_files) & (F.col("b1") >= budget), "L1").alias("due"))


def live_files(manifest: DataFrame) -> DataFrame:
    """manifest(pos, action, file_number): files whose last action is an add, in the order of their first."""
    last = manifest.groupBy("file_number").agg(F.max_by("action", "pos").alias("action"), F.min(F.when(F.col("action") == "add", F.col("pos"))).alias("first_add"))
    return last.where("action = 'add'").select("file_number", "first_add").orderBy("first_add")


def prune_stats(files: DataFrame, requests: DataFrame) -> DataFrame:
    """For each of requests(pos, key), how many files its range rules out and how many have to be read (pruned, read);
    unknown bounds (empty) rule out nothing.

    The files that hold a key are those that begin at it or before, less those that end before it: a running sum over
    bounds and keys in key order, by range partitions and over the partitions' sums. Linear in both tables."""
    known = files.where("smallest <> '' and largest <> ''")
    none = F.lit(None).cast("long")
    events = (
        known.select(F.col("smallest").alias("key"), F.lit(0).alias("k"), F.lit(1).alias("d"), none.alias("pos"))
        .unionByName(known.select(F.col("largest").alias("key"), F.lit(2).alias("k"), F.lit(-1).alias("d"), none.alias("pos")))
        .unionByName(requests.select("key", F.lit(1).alias("k"), F.lit(0).alias("d"), F.col("pos").cast("long").alias("pos")))
    )
    placed = paths.keep(events.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "bounds")
    sums = placed.groupBy("part").agg(F.sum("d").alias("d"))
    before = sums.select("part", F.coalesce(F.sum("d").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each partition
    here = F.sum("d").over(Window.partitionBy("part").orderBy("key", "k"))
    total = files.agg(F.count("*").alias("n"), F.count_if((F.col("smallest") == "") | (F.col("largest") == "")).alias("open"))
    held = placed.withColumn("here", here).where("k = 1").join(F.broadcast(before), "part").crossJoin(F.broadcast(total))  # one row
    return held.withColumn("read", F.col("here") + F.col("before") + F.col("open")).select("pos", "key", (F.col("n") - F.col("read")).alias("pruned"), "read")


def deletable_segments(segments: DataFrame, flushed_seq: int) -> DataFrame:
    """Closed log segments of segments(segment, seq) that are wholly flushed; the last one stays open."""
    by = segments.groupBy("segment").agg(F.max("seq").alias("max_seq"))
    return by.crossJoin(F.broadcast(by.agg(F.max("segment").alias("open")))).where((F.col("segment") < F.col("open")) & (F.col("max_seq") <= flushed_seq)).select("segment", "max_seq")


def create_checkpoint(log: DataFrame, path: str) -> None:
    """A copy of the log; a folder that exists is an error. It is written beside its place and then renamed, so that a
    folder of this name is always whole."""
    spark = log.sparkSession
    if paths.exists(spark, path):
        raise FileExistsError(path)
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    reach("checkpoint.write")
    try:
        log.write.parquet(beside)
        reach("checkpoint.written")
        paths.rename(spark, beside, path)
    except Exception:
        paths.delete(spark, beside)
        raise


def open_log(spark: SparkSession, *paths: str) -> tuple[DataFrame, int]:
    """The log in some folders, and the next sequence number."""
    log = replay(spark.read.parquet(paths[0]), spark.read.parquet(*paths[1:])) if len(paths) > 1 else spark.read.parquet(paths[0])
    return log, log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1


class Store:
    """A log in a folder whose file CURRENT names the version that is open, so that a commit is one replacement of a small
    file: readers see the version before it or the one after it, and a commit that fails changes nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[str]:
        """The versions that lie in the folder, among them such as were never or are no longer current."""
        return [n for n in paths.names(self.spark, self.folder) if n.startswith("v-")]

    @property
    def current(self) -> str | None:
        return paths.read_text(self.spark, f"{self.folder}/CURRENT")

    def read(self) -> DataFrame:
        at = self.current
        return self.spark.read.schema(LOG).parquet(f"{self.folder}/{at}") if at else self.spark.createDataFrame([], LOG)

    def commit(self, log: DataFrame, expected: str | None = None) -> str:
        """Make log the content. It is written and checked before it becomes current; what fails before that is
        deleted. With `expected`, it fails if another version has become current meanwhile."""
        name = f"v-{uuid.uuid4().hex}"
        at = f"{self.folder}/{name}"
        try:
            reach("store.write")
            write_run(log, at)
            reach("store.written")
            if not split_faulty(self.spark.read.schema(LOG).parquet(at))[1].isEmpty():
                raise ValueError("faulty rows")
            if expected is not None and self.current != expected:
                raise ValueError("another commit came first")
            reach("store.checked")
        except Exception:
            paths.delete(self.spark, at)
            raise
        reach("store.swap")  # the driver dies here: the version stays behind, unused, until vacuum()
        paths.replace_text(self.spark, f"{self.folder}/CURRENT", name)
        return name

    def compact(self, now_ms: int, level: int = BOTTOM, active_snapshots: int = 0, min_versions: int = 2) -> str:
        """Replace the content by its compaction. Refused while snapshots need old versions, and where no key has
        min_versions versions."""
        if active_snapshots:
            raise ValueError("snapshots are active")
        before = self.current
        if self.read().groupBy("key").count().where(F.col("count") >= min_versions).isEmpty():
            raise LookupError("nothing to compact")
        return self.commit(compact(self.read(), level, now_ms), before)

    def maybe_compact(self, now_ms: int, **options) -> str | None:
        """compact(), or null where there is nothing to compact."""
        try:
            return self.compact(now_ms, **options)
        except LookupError:
            return None

    def checkpoint(self, path: str) -> None:
        create_checkpoint(self.read(), path)

    def install(self, path: str) -> str:
        """Make a checkpoint the content; the open version stays if the checkpoint is missing or faulty."""
        return self.commit(self.spark.read.schema(LOG).parquet(path))

    def vacuum(self) -> list[str]:
        """Delete versions that are not current."""
        gone = [v for v in self.versions() if v != self.current]
        for v in gone:
            reach("vacuum.delete")
            paths.delete(self.spark, f"{self.folder}/{v}")
        return gone


def install_checkpoint(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Make a checkpoint the log in target, in place of what is open there."""
    store = Store(spark, target)
    store.install(path)
    return store.read()


def apply_commands(entries: DataFrame) -> DataFrame:
    """The log rows that committed entries(idx, op, key, value, expires_at_ms, ts_ms) make, numbered by
    idx: S puts, T puts with an expiry, D deletes; E gives a live key's value another expiry and does
    nothing for other keys; N and M change no key."""

    def begin():
        state: dict = {"value": None, "expires": 0}

        def step(row):
            if row is None or row["op"] in ("N", "M"):
                return []
            op, key = row["op"], row["key"]
            if op == "E":
                gone = state["value"] is None or 0 < state["expires"] <= row["ts_ms"]
                if gone:
                    return []
                state["expires"] = row["expires_at_ms"]
            else:
                state["value"] = None if op == "D" else row["value"]
                state["expires"] = row["expires_at_ms"] if op == "T" else 0
            return [(key, row["idx"], int(op == "D"), state["value"], state["expires"])]

        return step

    return stream_fold(entries, "key", ["idx"], begin, "key string, seq long, type int, value string, expires_at_ms long")


def committed_prefix(entries: DataFrame, commit_index: int, applied: int = 0) -> DataFrame:
    """Of entries(idx, term, …): those to apply next, contiguous from applied + 1 up to the commit index.
    An index that was written again counts with its greatest term."""
    one = entries.groupBy("idx").agg(F.max_by(F.struct(*[c for c in entries.columns if c != "idx"]), "term").alias("e"))
    todo = one.where((F.col("idx") > applied) & (F.col("idx") <= commit_index))
    gap = todo.agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count("*").alias("n"))
    # where an index is missing, what follows it waits
    after = todo.select((F.col("idx") + 1).alias("idx")).join(todo.select("idx"), "idx", "left_anti").agg(F.min("idx").alias("stop"))
    ready = todo.crossJoin(F.broadcast(after)).crossJoin(F.broadcast(gap.select("lo"))).where((F.col("lo") == applied + 1) & (F.col("idx") < F.col("stop")))
    return ready.select("idx", "e.*")


def commit_index(match: DataFrame, entries: DataFrame, term: int) -> DataFrame:
    """The greatest index of the current term that a majority of match(node, match_index) has."""
    rank = match.withColumn("n", F.count("*").over(Window.partitionBy())).withColumn("r", F.row_number().over(Window.orderBy(F.desc("match_index"))))  # a row for each node
    majority = rank.where(F.col("r") == F.floor(F.col("n") / 2) + 1).select("match_index")
    own = entries.where(F.col("term") == term).crossJoin(F.broadcast(majority)).where(F.col("idx") <= F.col("match_index"))
    return own.agg(F.coalesce(F.max("idx"), F.lit(0)).alias("commit_index"))


def truncate_conflicts(appends: DataFrame, width: int = 1 << 16) -> DataFrame:
    """The log that appends(pos, idx, term, data) leave: an entry whose index is there with another term removes that one
    and all after it; one that is there already changes nothing. As terms of a log only grow, an entry stays
    exactly if nothing new was written at its index or before it later on.

    The latest position up to an index is a running maximum: within ranges of indices, and over the ranges' maxima."""
    new = appends.groupBy("idx", "term").agg(F.min("pos").alias("pos"), F.min_by("data", "pos").alias("data")).withColumn("b", F.floor(F.col("idx") / width))
    tops = new.groupBy("b").agg(F.max("pos").alias("top")).withColumn("before", F.max("top").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each range
    upto = F.max("pos").over(Window.partitionBy("b").orderBy("idx").rangeBetween(Window.unboundedPreceding, 0))
    return new.withColumn("upto", upto).join(tops, "b").where(F.col("pos") >= F.greatest("upto", F.coalesce("before", F.col("pos")))).select("idx", "term", "data")


def compact_entries(entries: DataFrame, applied: int) -> DataFrame:
    """Entries that a snapshot up to `applied` does not hold."""
    return entries.where(F.col("idx") > applied)


def replication_lag(match: DataFrame, entries: DataFrame) -> DataFrame:
    """How many entries each of match(node, match_index) is behind the last."""
    last = entries.agg(F.coalesce(F.max("idx"), F.lit(0)).alias("last"))
    return match.crossJoin(F.broadcast(last)).select("node", F.greatest(F.col("last") - F.col("match_index"), F.lit(0)).alias("lag"))


def file_list(files: DataFrame) -> DataFrame:
    """Files as an administrator's listing shows them: by level, oldest first, keys in hexadecimal."""
    nth = F.row_number().over(Window.partitionBy("level").orderBy("file_number")) - 1
    return files.select("level", nth.alias("nth"), "file_number", F.lower(F.hex("smallest")).alias("smallest"), F.lower(F.hex("largest")).alias("largest"), "n_entries", "bytes")
