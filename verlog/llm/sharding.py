"""Sharding by sampled splitters.

Rows are ordered by (hash of the text, doc_id). A size-weighted sample gives quantile boundaries of
many fine ranges; exact byte counts of those ranges follow, and ranges that are overfull are cut
again by a sample of their own rows until none is. Consecutive ranges fill the shards; then ranges
move from the fullest to the emptiest shard while that brings them closer. Equal texts share a hash,
so they stay in one range, except a group that alone overfills one: it is cut by doc_id, and its
ranges go to one shard unless the group is larger than a shard.

Defined cases: null text counts as empty (size 1, crc32 0); repeated rows are all kept and placed;
an empty table gives no rows; other input columns are ignored; null doc_id sorts first; a text larger than
a shard gets a shard's range to itself; texts of one size are ordered by hash, ties by doc_id; rows that
repeat with text and doc_id can't be told apart, so they stay in one range however many they are.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

NO_ID = -(2**63)


def _records(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )


def _with_range(df: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """Adds rng: how many splitters (key, doc_id) are at or before the row."""
    keys = np.array([k for k, _ in splitters], dtype=np.int64)
    ids = np.array([i for _, i in splitters], dtype=np.int64)
    tied = set(keys.tolist())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            first = np.searchsorted(keys, key, side="left")
            rng = first.copy()
            for at in np.flatnonzero(np.isin(key, keys)) if tied else ():
                end = np.searchsorted(keys, key[at], side="right")
                own = batch.column("doc_id")[int(at)].as_py()
                rng[at] = first[at] + bisect.bisect_right(ids, NO_ID if own is None else own, first[at], end) - first[at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rng.astype(np.int64))], names=[*batch.schema.names, "rng"])

    return df.mapInArrow(place, f"{', '.join(f'{c} {t}' for c, t in df.dtypes)}, rng long")


def _sample(df: DataFrame, total: int, rows: int) -> list[tuple[int, int, float]]:
    """About `rows` rows as (key, doc_id, weight), drawn in proportion to size; the same each time."""
    share = F.col("size") * (rows / max(total, 1))
    draw = F.pmod(F.xxhash64("doc_id", "key", F.lit(7)), F.lit(1 << 40)) / float(1 << 40)
    got = df.where(draw < share).select("key", F.coalesce("doc_id", F.lit(NO_ID)), F.greatest(F.col("size").cast("double"), F.lit(total / rows))).collect()
    return sorted((k, i, w) for k, i, w in got)


def _quantiles(sample: list[tuple[int, int, float]], pieces: int) -> list[tuple[int, int]]:
    """Boundaries of about `pieces` ranges of equal weight. A boundary falls between two keys unless
    one key alone outweighs a range; then it falls between two ids of that key."""
    step = sum(w for *_, w in sample) / max(pieces, 1)
    per_key: dict[int, float] = {}
    for k, _, w in sample:
        per_key[k] = per_key.get(k, 0) + w
    cuts, filled, last = [], 0.0, None
    for k, i, w in sample:
        hot = per_key[k] > step
        new_key = k != last
        if filled > 0 and (filled + w / 2 >= step and (new_key or hot) or hot and new_key):
            cuts.append((k, NO_ID if new_key else i))
            filled = 0.0
        filled += w
        if last is not None and new_key and per_key[last] > step and cuts[-1:] != [(k, NO_ID)] and filled > w:
            cuts.append((k, NO_ID))
            filled = w
        last = k
    return cuts


def _fill(sizes: list[int], shards: int) -> list[int]:
    """A shard for each range: consecutive ranges first, then moves that narrow the widest gap."""
    total, done, of = sum(sizes), 0, []
    for s in sizes:
        of.append(min(shards - 1, int((done + s / 2) * shards / max(total, 1))))
        done += s
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for r, (s, at) in enumerate(zip(sizes, of, strict=True)):
        load[at] += s
        held[at].append((s, r))
    for h in held:
        h.sort()
    for _ in range(4 * len(sizes)):
        hi, lo = load.index(max(load)), load.index(min(load))
        gap = load[hi] - load[lo]
        at = bisect.bisect_right(held[hi], (gap // 2, len(sizes)))
        near = [x for x in held[hi][max(0, at - 1) : at + 1] if 0 < x[0] < gap]
        if not near:
            break
        s, r = min(near, key=lambda x: (abs(2 * x[0] - gap), x))
        held[hi].remove((s, r))
        bisect.insort(held[lo], (s, r))
        load[hi] -= s
        load[lo] += s
        of[r] = lo
    return of


def assign_shards(
    df: DataFrame, *, shards: int = 8, ranges_per_shard: int = 256, rows_per_range: int = 2_000_000,
    samples_per_range: int = 32, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null) of every row.

    The driver holds one boundary and one count for each range, and samples_per_range sampled keys
    for each; the number of ranges is shards * ranges_per_shard, or one for rows_per_range rows.
    """
    spark = df.sparkSession
    rows = stage(_records(df, id_col, text_col), "sizes")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    pieces = max(shards * ranges_per_shard, math.ceil(n / rows_per_range))
    cuts = sorted(set(_quantiles(_sample(rows, total, samples_per_range * pieces), pieces)))
    while True:
        placed = _with_range(rows, cuts)
        found = {r: (b, c) for r, b, c in placed.groupBy("rng").agg(F.sum("size"), F.count("*")).collect()}
        over = {r for r, (b, c) in found.items() if c > 1 and b > 3 * total / pieces}
        if not over:
            break
        mine = placed.join(F.broadcast(spark.createDataFrame([(r,) for r in sorted(over)], "rng long")), "rng")
        weight = sum(found[r][0] for r in over)
        inside: dict[int, list] = {}
        for k, i, w in _sample(mine, weight, samples_per_range * max(len(over), math.ceil(weight * pieces / max(total, 1)))):
            inside.setdefault(bisect.bisect_right(cuts, (k, i)), []).append((k, i, w))
        more = {c for r, s in inside.items() for c in _quantiles(s, math.ceil(found.get(r, (0, 0))[0] * pieces / total))}
        if more <= set(cuts):  # rows that repeat with text and id can't be divided
            break
        cuts = sorted({*cuts, *more})
    ranges = sorted(found)
    groups: list[list[int]] = []  # ranges that follow each other within one text
    for r in ranges:
        if groups and r == groups[-1][-1] + 1 and cuts[r - 1][1] != NO_ID:
            groups[-1].append(r)
        else:
            groups.append([r])
    blocks: list[list[int]] = []  # ranges that move together
    for g in groups:
        blocks += [g] if sum(found[r][0] for r in g) <= total / shards else [[r] for r in g]
    of = _fill([sum(found[r][0] for r in b) for b in blocks], shards)
    filled, table = [0] * shards, []
    for r, at in ((r, at) for b, at in zip(blocks, of, strict=True) for r in b):
        table.append((r, at, filled[at]))
        filled[at] += found[r][1]
    plan = F.broadcast(spark.createDataFrame(table, "rng long, shard int, first long"))  # one row for each range
    within = F.row_number().over(Window.partitionBy("rng").orderBy("key", "doc_id", "size"))
    return (
        _with_range(rows, cuts).withColumn("nth", within).join(plan, "rng")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                (F.col("first") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def write_shards(df: DataFrame, plan: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the rows of df into one folder for each shard of an assignment with unique ids."""
    df.join(plan.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col).write.partitionBy("shard").parquet(path)
