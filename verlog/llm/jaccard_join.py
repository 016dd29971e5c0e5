"""Exact Jaccard self-join of documents on word shingles, as a metric-space join.

A document is the set of its distinct shingles of five words; the Jaccard distance of sets is a
metric. Pairs at distance EPS = 0.25 or less are links, and the result is the classes that links join.
Sets with equal digests are one class throughout, so copies cost nothing.

1. Pivots are sets of the input, no two of them linked, that lie densest: where many others share most
   shingles. A set within EPS of its nearest pivot belongs to that pivot's Voronoi region and is linked
   to the pivot. It needs no comparison with the others there.
2. Windows. A set at distance d <= 2 EPS from a pivot may be linked to a member of its region, by the
   triangle inequality only to members at d - EPS or more. It is replicated to that region, unless
   links between pivots have joined its own region with that one, and compared with those members.
3. Sets of no region are beyond every pivot: nearly all texts are at distance 1 from each other, where the
   triangle inequality says nothing. They are divided into cells by rare shingles instead. Two linked
   sets share one of the first |x| - ceil(0.75 |x|) + 1 elements of either, in any common order of
   shingles, so each set goes to the cells of its first elements. Frequent shingles (counted over all
   documents) come last in the order, so shared passages hardly make cells. With SHARED - 1 elements more,
   linked sets share SHARED of them, so pairs that meet in fewer cells, by chance, are no candidates. Nor are
   those that sizes and places rule out. The others are compared in full.
4. Recursion. The sets of cells with more than CELL sets are joined anew as an input of their own: with
   their own pivots and regions, their own count of shingles, and a larger CELL, until no cell is
   too large.

Each pair of linked sets is found in one of three ways: both in regions that pivots and their members join,
one replicated to the other's region, or both in a cell. Without regions or without replicas links are
lost. Pivots and order change the work, never the result.

What reaches the driver: frequent shingles (FREQUENT of them at most, by count), PIVOTS sets of bounded
total size, links between pivots, and counts.

Words are runs of other bytes than ASCII white space, A-Z lower-cased. With fewer than five words
the whole sequence is one shingle. Shingles and sets are compared by 64-bit digests.

Defined cases: text that is null or has no words has the empty set, n_shingles 0, and is linked with
nothing; repeated rows are copies; rows that share a doc_id, or have none, are told apart by their
texts, and links through them count; a class none of whose rows has a doc_id has component_id null; an
empty table gives no rows; other columns, whatever their names, are ignored (the filter keeps them);
very long texts are sets of any size.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, drop_staged, fresh, give_back, stage, texts

WORDS = 5
LINK, OF = 75, 100  # linked if OF * intersection >= LINK * union
EPS = 1 - LINK / OF
IN_TASK, FREQUENT_FROM, FREQUENT = 2, 3, 1 << 20
PIVOTS, PIVOT_SHINGLES, TASK_PIVOTS, BALL = 2048, 1 << 21, 64, 3
SHARED = 3  # first elements that candidates share; linked sets that differ have at least three in common
CELL, LARGER = 256, 4  # sets of a cell that is compared at once; how much more at each level
CHUNK = 2_000_000  # shingles that a task of the first pass holds at once
HELD = 500_000  # cell entries that a task of the second pass holds at once
BUCKET = 500_000  # cell entries of a bucket, about
BROADCAST_IDS = 1_000_000
PARTNERS = 128
BLOCK, MEMBERS = 100_000, 250  # shingles of the replicas, members of a region that meet in one task
ENTRY = np.dtype([("h", "<u8"), ("cls", "<i8"), ("n", "<u4"), ("pos", "<u2")])
PLACED = np.dtype([("kind", "<i4"), ("a", "<i8"), ("b", "<i8"), ("c", "<i8"), ("n", "<i8"), ("d", "<f8")])
#: rows of a level: candidate pairs a < b; sets a of cells that are too large; sets a in the region b at
#: distance d from its pivot; replicas of sets a of region c (-1: none) in region b; regions a and b that share a set
PAIR, LARGE, HOME, REPLICA, JOINT = range(5)


class _Words(dict):
    """Digests of words; forgets them all when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@functools.lru_cache(1)
def _digests() -> _Words:
    return _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct digests of a text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_digests().__getitem__, words), np.uint64, len(words))
    if len(w) < WORDS:
        h = np.array([len(w)], np.uint64)
        for x in w:
            h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + x)
        return h
    m = np.uint64(0xBF58476D1CE4E5B9)
    n = len(w) - WORDS + 1
    h = w[:n].copy()
    for k in range(1, WORDS):
        h *= m
        h += w[k : k + n]
    return np.unique(_mix(h))


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def linked(common: int, a: int, b: int) -> bool:
    return OF * common >= LINK * (a + b - common)


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


# --- first pass: classes, frequent shingles, pivot candidates


def _row_key() -> Column:
    """A digest of a row's doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def _survey(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, n, cls, at (the row's key). kind 1: a shingle (cls) and in how many sets of a chunk it is (n).
    kind 2: a pivot candidate (cls) with its set and how many sets of a chunk are linked to it (n)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0
        names = ["kind", "doc_id", "n", "cls", "data", "at"]

        def rows(kind: int, ids: list, n, cls, data: list, at: pa.Array | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(data, pa.binary()),
                 pa.nulls(len(ids), pa.int64()) if at is None else at], names=names)

        def candidates(twice: np.ndarray) -> Iterator[pa.RecordBatch]:
            """The sets that share most of their shingles here, no two of which are linked, if BALL others here are linked to
            them: those that share more are nearer to what their family has in common."""
            shares = []
            for cls, s in held.items():
                at = np.searchsorted(twice, s)
                at[at == len(twice)] = 0
                hit = at[twice[at] == s] if len(twice) else at[:0]
                if 2 * len(hit) >= len(s) and len(s) <= PIVOT_SHINGLES // 64:
                    shares.append((-len(hit) / len(s), cls))
            chosen, kept, balls = Pivots([]), [], []
            for _, cls in sorted(shares):
                near = chosen.linked_to(held[cls]) if kept else ()
                for k in near:
                    balls[k] += 1
                if not len(near) and len(kept) < 4 * TASK_PIVOTS:
                    kept.append((cls, held[cls]))
                    balls.append(0)
                    chosen = Pivots(kept)
            best = sorted(((-n, c, s) for n, (c, s) in zip(balls, kept, strict=True) if n >= BALL), key=lambda x: x[:2])
            for n, cls, s in best[:TASK_PIVOTS]:
                yield rows(2, [None], [-n], [cls], [s.tobytes()])

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if len(held) >= 2:
                every = np.concatenate(list(held.values()))
                every.sort()
                first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
                count = np.diff(np.append(first, len(every)))
                many = count >= IN_TASK
                often, count = every[first[many]], count[many]
                del every, first, many
                yield from candidates(often)
                if len(often):
                    yield rows(1, [None] * len(often), count, often.view(np.int64), [None] * len(often))
            held.clear()
            size = 0

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            n, cls = [], []
            for i, text in texts(batch.column("text")):
                s = shingles(text)
                n.append(len(s))
                cls.append(class_of(s) if len(s) else None)
                if len(s) and cls[-1] not in held:
                    held[cls[-1]] = s
                    size += len(s)
                    if size >= CHUNK:
                        yield from close()
            yield rows(0, ids, n, cls, [None] * len(ids), batch.column("at"))
        yield from close()
        _digests().clear()
        give_back()

    keyed = docs.select(F.col("doc_id").cast("long"), "text", _row_key().alias("at"))
    return keyed.mapInArrow(task, "kind int, doc_id long, n long, cls long, data binary, at long")


class Lookup:
    """Where shingles are in a sorted array; a table of their last bits answers for nearly all that are not in it."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.table = keys, None

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "table": None}

    def find(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of s are there, and the places of those."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.table is None:
            bits = min(24, max(10, 4 + int(len(self.keys)).bit_length()))
            self.last = np.uint64((1 << bits) - 1)
            self.table = np.zeros(1 << bits, bool)
            self.table[(self.keys & self.last).astype(np.int64)] = True
        may = np.flatnonzero(self.table[(s & self.last).view(np.int64)])
        at = np.searchsorted(self.keys, s[may])
        at[at == len(self.keys)] = 0
        there = self.keys[at] == s[may]
        return may[there], at[there]


class Pivots:
    """Sets with an index of their shingles."""

    def __init__(self, sets: list[tuple[int, np.ndarray]], family: list[int] | None = None):
        self.cls = [c for c, _ in sets]
        self.family = family if family is not None else list(range(len(sets)))
        self.n = np.array([len(s) for _, s in sets], dtype=np.int64)
        flat = np.concatenate([s for _, s in sets]) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.n) if sets else np.zeros(0, np.int32)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        shingle, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))
        self.shingles = Lookup(shingle)

    def common(self, s: np.ndarray) -> np.ndarray:
        """How many shingles each set has in common with s."""
        _, at = self.shingles.find(s)
        n = self.first[at + 1] - self.first[at]
        rows = np.repeat(self.first[at] - np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64), n) + np.arange(n.sum())
        return np.bincount(self.owner[rows], minlength=len(self.cls))

    def linked_to(self, s: np.ndarray) -> np.ndarray:
        common = self.common(s)
        return np.flatnonzero(OF * common >= LINK * (self.n + len(s) - common))

    def near(self, s: np.ndarray) -> list[tuple[int, float, bool]]:
        """The pivots within 2 EPS of s, the nearest first, their distances, and whether they are linked. That needs
        half of the elements in common, so one of any half and one more."""
        if not len(self.cls) or not len(self.shingles.find(s[: len(s) // 2 + 1])[0]):
            return []
        common = self.common(s)
        apart = 1 - common / (self.n + len(s) - common)
        who = np.flatnonzero(apart <= 2 * EPS + 1e-9)
        who = who[np.argsort(apart[who], kind="stable")]
        return [(p, float(apart[p]), linked(int(common[p]), len(s), int(self.n[p]))) for p in who.tolist()]


def _top(family: list[int], x: int) -> int:
    while family[x] != x:
        family[x] = family[family[x]]
        x = family[x]
    return x


def _unite(family: list[int], x: int, y: int) -> bool:
    x, y = _top(family, x), _top(family, y)
    family[max(x, y)] = min(x, y)
    return x != y


def _choose_pivots(found: DataFrame) -> Pivots:
    """Of the densest candidates, by how many others they are linked to, those that no chosen one is
    linked to; candidates linked to several join their families. What is looked at is bounded in number and size."""
    sets: dict[int, np.ndarray] = {}
    size = 0
    for row in found.orderBy(F.desc("n"), "cls").limit(2 * PIVOTS).toLocalIterator():
        s = np.frombuffer(row.data, np.uint64)
        if size + len(s) > PIVOT_SHINGLES:
            break
        if row.cls not in sets:
            sets[row.cls] = s
            size += len(s)
    every = Pivots(list(sets.items()))
    links = [every.linked_to(s) for s in sets.values()]
    place: dict[int, int] = {}
    free = np.ones(len(links), bool)
    for i in sorted(range(len(links)), key=lambda i: (-len(links[i]), every.cls[i])):
        if free[i] and len(place) < PIVOTS:
            place[i] = len(place)
            free[links[i]] = False
    family = list(range(len(place)))
    for own in links:
        joint = [place[int(i)] for i in own if int(i) in place]
        for other in joint[1:]:
            _unite(family, joint[0], other)
    return Pivots([(every.cls[i], sets[every.cls[i]]) for i in place], [_top(family, x) for x in range(len(family))])


# --- second pass: regions, replicas and cells


def _deal(docs: DataFrame, often: tuple[np.ndarray, np.ndarray], pivots: Pivots, buckets: int, cell: int) -> DataFrame:
    """bucket >= 0: entries of its cells. bucket < 0: PLACED rows other than pairs."""
    shared = docs.sparkSession.sparkContext.broadcast((Lookup(often[0]), often[1], pivots))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, count, index = shared.value
        seen: set[int] = set()
        placed: list[tuple] = []
        cls_of: list[int] = []
        firsts: list[np.ndarray] = []
        sizes: list[int] = []
        family = list(index.family)
        size = out = 0

        def row(bucket: int, data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([data], pa.binary())], names=["bucket", "data"])

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal size, out
            if size:
                h = np.concatenate(firsts)
                to = (_mix(h) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                ends = np.searchsorted(to[order], np.arange(buckets + 1))
                n_of = [len(f) for f in firsts]
                columns = [h[order], np.repeat(np.array(cls_of, np.int64), n_of)[order], np.repeat(np.array(sizes, np.uint32), n_of)[order],
                           np.concatenate([np.minimum(np.arange(n), 65535).astype(np.uint16) for n in n_of])[order]]
                del h, to, order
                for b in np.flatnonzero(np.diff(ends)):
                    yield row(int(b), b"".join(c[ends[b] : ends[b + 1]].tobytes() for c in columns))
            for d in (cls_of, firsts, sizes):
                d.clear()
            size = 0
            if placed:
                out += 1
                yield row(-1 - out % buckets, np.array(placed, PLACED).tobytes())
                placed.clear()

        for batch in batches:
            for _, text in texts(batch.column("text")):
                s = shingles(text)
                if not len(s):
                    continue
                cls = class_of(s)
                if cls in seen:
                    continue
                if len(seen) > 300_000:
                    seen.clear()
                seen.add(cls)
                close_by = index.near(s)
                home = close_by[0][0] if close_by and close_by[0][2] else -1
                for p, d, is_link in close_by:
                    if p == home:
                        placed.append((HOME, cls, p, p, len(s), d))
                    elif is_link:
                        if _unite(family, p, home):  # the two pivots share a neighbour
                            placed.append((JOINT, p, home, -1, 0, d))
                    elif home < 0 or index.family[p] != index.family[home]:
                        placed.append((REPLICA, cls, p, home, len(s), d))
                if home < 0:
                    k = len(s) - -(-LINK * len(s) // OF) + SHARED
                    there, at = shingle.find(s)
                    many = np.zeros(len(s), bool)
                    many[there] = True
                    first = s[~many][:k]
                    if len(first) < k:
                        order = np.lexsort((at, count[at]))[: k - len(first)]
                        fits = count[at[order]] <= cell
                        if not fits.all():  # the rarest come first
                            placed.append((LARGE, cls, -1, -1, len(s), 1.0))
                        first = np.concatenate((first, s[there[order[fits]]]))
                    cls_of.append(cls)
                    firsts.append(first)
                    sizes.append(len(s))
                    size += len(first)
                if size >= HELD or len(placed) >= HELD // 8:
                    yield from close()
        yield from close()
        _digests().clear()
        give_back()

    return docs.select("text").mapInArrow(task, "bucket int, data binary")


def _pair_up(dealt: DataFrame, cell: int) -> DataFrame:
    """PLACED rows: those of dealt, pairs that meet in n cells, and the sets of cells that are too large."""

    def rows(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        none = np.zeros(len(a), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *map(pa.array, (a, b, none, n, none.astype(float)))], names=list(PLACED.names))

    def counted(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return a[new], b[new], np.add.reduceat(n, np.flatnonzero(new)) if len(n) else n

    def bucket(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[] for _ in ENTRY.names]
        for data in parts:
            size, at = len(data) // ENTRY.itemsize, 0
            for f, c in zip(ENTRY.names, columns, strict=True):
                c.append(np.frombuffer(data, ENTRY[f], size, at))
                at += size * ENTRY[f].itemsize
        h = np.concatenate(columns[0])
        order = np.argsort(h, kind="stable")
        h = h[order]
        shared = np.zeros(len(h), bool)  # most shingles are in one set
        shared[1:] |= h[1:] == h[:-1]
        shared[:-1] |= h[1:] == h[:-1]
        order, h = order[shared], h[shared]
        cls = np.concatenate(columns[1])[order]
        again = np.lexsort((cls, h))
        order, h, cls = order[again], h[again], cls[again]
        new = np.ones(len(h), bool)  # a class comes from several tasks
        new[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])
        order, h, cls = order[new], h[new], cls[new]
        n, pos = np.concatenate(columns[2])[order].astype(np.int64), np.concatenate(columns[3])[order].astype(np.int64)
        columns.clear()
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(h)))
        large = np.repeat(size > cell, size)
        if large.any():
            who = np.unique(cls[large])
            yield rows(LARGE, who, np.full(len(who), -1), np.zeros(len(who), np.int64))
        start, size = start[size <= cell], size[size <= cell]
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0
        for d in range(1, int(size.max(initial=0))):
            start, size = start[size > d], size[size > d]
            if not len(start):
                break
            step = max(1, 500_000 // int(size.max()))
            for k in range(0, len(start), step):
                at, count = start[k : k + step], size[k : k + step] - d
                i = np.repeat(at - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                j = i + d
                ok = OF * np.minimum(n[i], n[j]) >= LINK * np.maximum(n[i], n[j])
                # what is left from these places on, for the first SHARED of what linked sets have in common
                ok &= (LINK + OF) * (np.minimum(n[i] - pos[i], n[j] - pos[j]) + SHARED - 1) >= LINK * (n[i] + n[j])
                i, j = i[ok], j[ok]
                held.append((cls[i], cls[j], np.ones(len(i), np.int64)))  # in order within a cell
                waiting += len(i)
                if waiting > 300_000:
                    held = [counted(*map(np.concatenate, zip(*held, strict=True)))]
                    waiting = len(held[0][0])
                    if waiting > 150_000:
                        yield rows(PAIR, *held[0])
                        held, waiting = [], 0
        if waiting:
            yield rows(PAIR, *counted(*map(np.concatenate, zip(*held, strict=True))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = -1, []
        for batch in batches:
            for k in range(batch.num_rows):
                b, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if b < 0:
                    own = np.frombuffer(data, PLACED)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(own[f])) for f in PLACED.names], names=list(PLACED.names))
                    continue
                if b != now and parts:
                    yield from bucket(parts)
                    parts = []
                now = b
                parts.append(data)
        if parts:
            yield from bucket(parts)
        give_back()

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(task, "kind int, a long, b long, c long, n long, d double")


# --- third pass: whole comparisons


def _verify(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pairs(a, b) of ids that are links. wanted(id, packed) has the texts. A text travels to each
    pair it is in, grouped by a: a task holds one set and streams the partners. An a with many partners
    is dealt out to several groups of PARTNERS."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, unzip = None, None, zstandard.ZstdDecompressor()
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            out = []
            for i, packed in enumerate(batch.column("packed")):
                s = shingles(unzip.decompress(packed.as_py()).decode())
                if b[i] is None:
                    now, own = a[i], s
                elif a[i] == now and linked(common_count(own, s), len(own), len(s)):
                    out.append((a[i], b[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
        _digests().clear()
        give_back()

    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    # texts stay where they are while the pairs fit into every task; else both sides are shuffled
    if pairs.count() <= BROADCAST_IDS:
        parts, dealt = F.broadcast(parts), F.broadcast(dealt)
    own = wanted.join(parts, F.col("a") == F.col("id")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "packed")
    other = wanted.join(dealt, F.col("b") == F.col("id")).select("a", "part", "b", "packed")
    return own.unionByName(other).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b")).mapInArrow(task, "a long, b long")


def _meet(replicas: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """Links (a, b) of replicas(a, b: region, n, d) to members(a, b: region, d) of the regions.

    The members of a region are linked to its pivot, so one link of a replica says all. Replicas meet
    members in blocks: a task indexes BLOCK shingles of replicas of one region, about, and streams
    MEMBERS of its members, about, past them, until each replica has a link."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, index, free, unzip = None, [], None, None, zstandard.ZstdDecompressor()
        for batch in batches:
            key = list(zip(*(batch.column(c).to_pylist() for c in ("b", "block", "chunk")), strict=True))
            cls, role = batch.column("a").to_pylist(), batch.column("role").to_pylist()
            out = []
            for i, packed in enumerate(batch.column("packed")):
                if key[i] != now:
                    now, sets, index = key[i], [], None
                if role[i] and index is not None and not free.any():
                    continue
                s = shingles(unzip.decompress(packed.as_py()).decode())
                if not role[i]:
                    sets.append((cls[i], s))
                    continue
                if index is None:
                    index, free, sets = Pivots(sets), np.ones(len(sets), bool), []
                for k in index.linked_to(s):
                    if free[k]:
                        free[k] = False
                        out.append((index.cls[k], cls[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
        _digests().clear()
        give_back()

    # a row for each region: PIVOTS at most
    blocks = F.broadcast(replicas.groupBy("b").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks")))
    chunks = F.broadcast(members.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS).alias("chunks")))

    def spread(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def one(n: str) -> Column:
        return F.pmod(F.xxhash64("a"), F.col(n))

    replica = replicas.join(blocks, "b").join(chunks, "b").select("b", one("blocks").alias("block"), spread("chunks").alias("chunk"), F.lit(0).alias("role"), "a")
    member = members.join(blocks, "b").join(chunks, "b").select("b", spread("blocks").alias("block"), one("chunks").alias("chunk"), F.lit(1).alias("role"), "a")
    rows = replica.unionByName(member).join(wanted, F.col("a") == F.col("id")).select("b", "block", "chunk", "role", "a", "packed")
    return rows.repartition("b", "block", "chunk").sortWithinPartitions("b", "block", "chunk", "role").mapInArrow(task, "a long, b long")


def _packed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Staged (id, packed) of the texts of docs(text, at) that ids(id, at) wants, one row for each id: texts
    travel compressed. Rows of an id are repeats."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            pack, at, data, rows = zstandard.ZstdCompressor(level=3), batch.column("at").to_pylist(), [], []
            for i, t in texts(batch.column("text")):
                if t is not None and at[i] not in seen:
                    if len(seen) > 300_000:
                        seen.clear()
                    seen.add(at[i])
                    rows.append(at[i])
                    data.append(pack.compress(t.encode()))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(data, pa.binary())], names=["at", "packed"])
        give_back()

    ids = stage(ids, "wanted")
    if ids.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(ids.select("at").distinct()), "at", "left_semi")
        ids = F.broadcast(ids)
    packed = docs.select("text", "at").mapInArrow(task, "at long, packed binary").join(ids, "at")
    return stage(packed.groupBy("id").agg(F.first("packed").alias("packed")), "texts")


def _labelled(edges: DataFrame, components: DataFrame) -> DataFrame:
    """The edges whose ends are of different components."""
    x, y = components.toDF("a", "ra"), components.toDF("b", "rb")
    both = edges.join(x, "a", "left").join(y, "b", "left")
    return both.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _level(docs: DataFrame, survey: DataFrame, entries: int, cell: int) -> tuple:
    """The links (a, b) of classes to pivots and of pivots; candidate pairs; replicas and the members of regions that they may
    be linked to; the classes whose texts these need; the classes of cells that are too large (None: there are none). docs: text, at; survey: that of their texts."""
    spark = docs.sparkSession
    buckets = max(1, math.ceil(entries / BUCKET))
    pivots = _choose_pivots(survey.where("kind = 2"))
    counted = survey.where("kind = 1").groupBy("cls").agg(F.sum("n").alias("n")).where(f"n >= {FREQUENT_FROM}")
    table = counted.orderBy(F.desc("n"), "cls").limit(FREQUENT).toArrow()
    shingle, count = table["cls"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(shingle)
    placed = stage(_pair_up(_deal(docs, (shingle[order], count[order]), pivots, buckets, cell), cell), "placed")

    family = list(pivots.family)
    joints = placed.where(f"kind = {JOINT}").select("a", "b").distinct()  # of pivots only, at most one fewer than there are from each task
    for r in joints.toLocalIterator():
        _unite(family, r.a, r.b)
    names = F.broadcast(spark.createDataFrame([(k, c, _top(family, k)) for k, c in enumerate(pivots.cls)], "place long, pivot long, family long"))  # PIVOTS rows at most
    home = placed.where(f"kind = {HOME}")
    first = names.select(F.col("family").alias("other"), F.col("pivot").alias("head")).where("other = place")
    links = home.join(names, F.col("b") == F.col("place")).select("a", F.col("pivot").alias("b")).unionByName(
        names.join(first, F.col("family") == F.col("other")).select(F.col("pivot").alias("a"), F.col("head").alias("b"))
    ).where("a <> b").distinct()

    own = names.select(F.col("place").alias("c"), F.col("family").alias("mine"))
    # how far out each region has members: a row for each
    rim = F.broadcast(home.groupBy(F.col("b").alias("place")).agg(F.max("d").alias("rim")).join(names, "place"))
    replicas = placed.where(f"kind = {REPLICA}")
    replicas = replicas.join(rim, (F.col("b") == F.col("place")) & (F.col("d") <= F.col("rim") + EPS + 1e-9)).join(own, "c", "left").where("mine is null or mine <> family")
    replicas = replicas.groupBy("a", "b").agg(F.first("n").alias("n"), F.min("d").alias("d"))
    lowest = F.broadcast(replicas.groupBy("b").agg((F.min("d") - EPS - 1e-9).alias("lowest")))  # a row for each region
    members = home.join(lowest, "b").where("d >= lowest").select("a", "b", "d").distinct()
    replicas, members = stage(replicas, "replicas"), stage(members, "members")
    pairs = stage(placed.where(f"kind = {PAIR}").groupBy("a", "b").agg(F.sum("n").alias("n")).where(f"n >= {SHARED}").select("a", "b"), "pairs")
    large = placed.where(f"kind = {LARGE}").select("a").distinct()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(replicas.select(F.col("a").alias("id"))).unionByName(members.select(F.col("a").alias("id"))).distinct()
    return stage(links, "links"), pairs, replicas, members, wanted, None if large.isEmpty() else large, placed


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to) of every row."""
    return _classes(docs).select("doc_id", "n_shingles", "component_id")


def _classes(docs: DataFrame) -> DataFrame:
    """The same with at (the row's key) and root, a number for all that is linked (null: no shingles)."""
    survey = stage(_survey(docs), "survey")
    rows = survey.where("kind = 0").select("doc_id", "n", "cls", "at")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.min("at").alias("at"))
    classes = stage(classes, "classes")  # at: the row that lends its text
    keyed = docs.select("text", _row_key().alias("at"))
    part, members, cell, links, again = keyed, classes, CELL, None, survey
    while True:
        entries = members.agg(F.sum(F.col("n") - F.ceil(F.col("n") * (LINK / OF)) + SHARED)).first()[0] or 0
        own, pairs, replicas, inside, wanted, large, placed = _level(part, again, entries, cell)
        packed = _packed(part, wanted.join(classes.select(F.col("cls").alias("id"), "at"), "id"))
        met = _meet(replicas, inside, packed)
        star = stage(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "star")
        links = own if links is None else links.unionByName(own)
        links = stage(links.unionByName(met).unionByName(_verify(star, packed)), "first")
        components = connected_components(links)
        left = stage(_labelled(pairs.join(star, ["a", "b"], "left_anti"), components), "left")
        if not left.isEmpty():
            links = stage(links.unionByName(_verify(left, packed)), "all")
            components = connected_components(links)
        drop_staged(pairs, replicas, inside, packed, star, left)
        if large is None:
            drop_staged(placed)
            break
        # the sets of the cells that are too large are an input of their own
        members = stage(classes.join(large.withColumnRenamed("a", "cls"), "cls"), "large")
        drop_staged(placed)
        chosen = members.select("at")
        part = stage(keyed.join(F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen, "at", "left_semi").dropDuplicates(["at"]), "part")
        again, cell = stage(_survey(part.withColumn("doc_id", F.lit(None).cast("long"))), "survey"), cell * LARGER
    members = components.unionByName(components.select(F.col("root").alias("node"), "root").distinct())  # roots have no row of their own
    least = members.join(classes.select(F.col("cls").alias("node"), "id"), "node").groupBy("root").agg(F.min("id").alias("least"))
    named = classes.select("cls", "id").join(components.toDF("cls", "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = named.join(least, "root", "left").select("cls", "root", F.coalesce("least", "id").alias("least"))
    return rows.join(named, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "at", "root")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each class, that with the smallest doc_id, with all its columns. Linked rows
    that repeat a doc_id leave one row; rows without a doc_id stay."""
    found = stage(_classes(docs).select("doc_id", "component_id", "at", F.xxhash64("doc_id", "root").alias("same")), "classes")
    names = docs.columns
    at, same, nth = fresh(docs, "at"), fresh(docs, "same"), fresh(docs, "nth")
    drop = found.where("doc_id <> component_id").select(F.col("at").alias(at)).distinct()
    stay = found.where("doc_id = component_id")
    twice = stay.groupBy("same").count().where("count > 1").select("same")
    twice = stay.join(twice, "same").select(F.col("at").alias(at), F.col("same").alias(same)).distinct()
    drop, twice = stage(drop, "drop"), stage(twice, "twice")
    small = [F.broadcast(x) if x.count() <= BROADCAST_IDS else x for x in (drop, twice)]
    kept = docs.withColumn(at, _row_key()).join(small[0], at, "left_anti")
    if twice.isEmpty():
        return kept.select(*names)
    order = Window.partitionBy(same).orderBy(*(F.col(c) for c in names if c != "doc_id"))
    one = kept.join(small[1], at).withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    return kept.join(small[1], at, "left_anti").select(*names).unionByName(one.select(*names))
