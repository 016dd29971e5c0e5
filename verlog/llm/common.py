"""Helpers shared by the corpus operators: shared storage, staging and connected components."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW = 500_000  # edges that one task joins

_own_dir: list[str] = []
_made: list[str] = []
_rows_since = 0
_owner: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("owner", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's spark.checkpoint.dir. Only where that is unset on a local master, where all
    share one machine, a folder of this process is made.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="verlog-"))
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in (_made, _owner.get()):
        if made is not None:
            made.append(path)
    return path


@contextlib.contextmanager
def owned() -> Iterator[list[str]]:
    """The folders that are staged within, for delete(): their owner knows when nothing reads them any more."""
    token = _owner.set([])
    try:
        yield _owner.get()
    finally:
        _owner.reset(token)


def delete(spark: SparkSession, folders: list[str]) -> None:
    for at in folders:
        if at in _made:
            _made.remove(at)
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all that this process has staged, once no frame that reads it is needed any more."""
    delete(spark, list(_made))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: this cuts the lineage, and what
    was computed survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_staged(*dfs: DataFrame) -> None:
    """Delete the files of frames that stage() returned and nothing will read again."""
    for df in dfs:
        delete(df.sparkSession, [df._staged_at])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Return to the system what a task has freed: its worker goes on to other tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of the GNU C library
        ctypes.CDLL(None).malloc_trim(0)


def texts(column: pa.Array, chunk: int = 256, every: int = 4096) -> Iterator[tuple[int, str | None]]:
    """(row, text) of an Arrow string column; only `chunk` Python strings exist at once, and what is freed goes back to
    the system after each `every` rows of a worker."""
    global _rows_since
    for at in range(0, len(column), chunk):
        yield from enumerate(column.slice(at, chunk).to_pylist(), at)
        _rows_since += chunk
        if _rows_since >= every:
            _rows_since = 0
            give_back()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the pairs join: each node with the least id of its component."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _small_components(edges: DataFrame) -> DataFrame:
    """The same of at most FEW edges, in one task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            a.append(batch.column("a").to_numpy())
            b.append(batch.column("b").to_numpy())
        node, root = forest(np.concatenate(a), np.concatenate(b))
        for at in range(0, len(node), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(node[at : at + 100_000]), pa.array(root[at : at + 100_000])], names=["node", "root"])

    return stage(edges.repartition(1).mapInArrow(task, "node long, root long"), "components")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b) that is not the least of its component, which is its root.

    At most FEW edges, by count, are joined in one task. More take alternating large-star and small-star rounds,
    each written to shared storage. Every round is aggregations with partial sums and joins that adaptive
    execution can split, so that a node with a third of all edges is no hot spot. Links and labels stay in
    the cluster; only a count and a checksum of each round reach the driver. Self links and links of null are
    dropped; no edges give no rows.
    """
    edges = edges.select("a", "b").where("a <> b")
    if edges.count() <= FEW:
        return _small_components(edges)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # a > b throughout: b is the candidate root of a
    now = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    seen = mark(now)
    if not seen[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: larger neighbours of a node move to the least of its neighbourhood
        large = (
            both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: a node's smaller neighbours, and it, move to the least of them
        small = large.join(least, "a")
        after = stage(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct(),
            "links",
        )
        drop_staged(now)
        mark_after, now = mark(after), after
        if mark_after == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark_after
    raise RuntimeError("components did not settle")
