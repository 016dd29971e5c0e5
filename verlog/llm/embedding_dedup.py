"""Near-duplicate embeddings by an inverted multi-index.

The halves of the unit vectors have codebooks of their own; their products are the cells of a grid.
From a vector, cells are visited nearest first by a multi-sequence traversal: both half lists are sorted by
a lower bound of the distance, and a queue holds the next cells of the staircase that the visits form.
The squared distance to a cell is at least the sum of those to its half cells, so when the sum passes
the link radius no partner is left: recall is 1 by construction. With a target recall below 1, the traversal ends
earlier, at the distance within which that share of a sample's links is found; `measured_recall` tells what
that gave. What is visited is verified by the cosine in double precision.

A vector is at home in one product cell, and travels once to each half cell of its label that it visits cells
of, with the list of those. Half cells with more than HOT vectors are divided into their product cells, and
product cells with more than HOT into parts by id; their visitors go to each part. A vector's links are thus
counted in one place. Pairs never leave a task: it returns a count for each vector and a spanning forest
of the links. Equal vectors of one label are one class with a weight.

Codebooks are fitted on at most SAMPLE vectors (drawn by hash) and grow with the table; every vector is indexed.
The list of divided cells is joined, and broadcast only if Spark finds it small.

Defined cases: vectors that are null, empty or zero, or have null or non-finite components, and
those with a null label or id, link with nothing; vectors of different lengths don't link; repeated
rows are further vectors; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forest, stage

SAMPLE = 20_000
HOT = 20_000  # vectors of a block beyond which it is divided
ROWS, BATCH = 1024, 2048


def half_cells(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Lloyd's codebook of one half."""
    draw = np.random.default_rng(seed)
    centres = sample[draw.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        near = distances(sample, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        count = np.bincount(near, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)


def bounds(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each row, and lower bounds of its squared distance to every cell: to the
    plane halfway between the centres."""
    d = distances(x, centres)
    home = d.argmin(1)
    between = np.sqrt(distances(centres, centres))[home]
    gap = np.divide(d - d[np.arange(len(x)), home][:, None], 2 * between, out=np.zeros_like(d), where=between > 0)
    gap[np.arange(len(x)), home] = 0
    return home, np.maximum(gap - 1e-7, 0) ** 2


class Grid:
    def __init__(self, sample: np.ndarray, cells: int):
        self.cut = sample.shape[1] // 2
        self.books = [half_cells(sample[:, : self.cut], cells), half_cells(sample[:, self.cut :], cells)]

    def bounds(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [bounds(x[:, : self.cut], self.books[0]), bounds(x[:, self.cut :], self.books[1])]


def multi_sequence(a: np.ndarray, b: np.ndarray, limit: float) -> Iterator[tuple[int, int, float]]:
    """Pairs of places with a[i] + b[j] <= limit, the least sum first; a and b are sorted."""
    queue = [(float(a[0] + b[0]), 0, 0)]
    begun = {(0, 0)}
    while queue:
        total, i, j = heapq.heappop(queue)
        if total > limit:
            return
        yield i, j, total
        # a cell is queued once both cells before it, if any, have been visited
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in begun:
                begun.add((x, y))
                heapq.heappush(queue, (float(a[x] + b[y]), x, y))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _visits(classes: DataFrame, grids: dict[int, Grid], limits: dict[int, float]) -> DataFrame:
    """A row for each half cell i that a vector visits cells of: those cells' second halves, nearest first, and
    whether the first is its home, by second half (home: -1 if it is not here)."""
    shared = classes.sparkSession.sparkContext.broadcast(grids)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = shared.value
        for whole in batches:
            for begin in range(0, whole.num_rows, BATCH):
                batch = whole.slice(begin, BATCH)
                size = np.array(batch.column("size").to_pylist())
                rows, half, home, ends, cells = [], [], [], [0], []
                for dim in sorted(set(size.tolist())):
                    own = np.flatnonzero(size == dim)
                    (i0, lb), (j0, lb2) = grids[dim].bounds(_unit(_matrix(batch.column("vec").take(pa.array(own)))))
                    order, order2 = lb.argsort(1, kind="stable"), lb2.argsort(1, kind="stable")
                    for k, r in enumerate(own.tolist()):
                        visited: dict[int, list[int]] = {int(i0[k]): [int(j0[k])]}
                        for i, j, _ in multi_sequence(lb[k, order[k]], lb2[k, order2[k]], limits[dim]):
                            at = (int(order[k, i]), int(order2[k, j]))
                            if at != (i0[k], j0[k]):
                                visited.setdefault(at[0], []).append(at[1])
                        for i, js in visited.items():
                            rows.append(r)
                            half.append(i)
                            home.append(js[0] if i == i0[k] else -1)
                            cells += js
                            ends.append(len(cells))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(half, pa.int32()), pa.array(home, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cells, pa.int32())),
                     *(batch.column(c).take(at) for c in ("size", "label", "id", "weight", "vec"))],
                    names=["i", "home", "cells", "size", "label", "id", "weight", "vec"])

    kind = dict(classes.dtypes)["vec"]
    return classes.mapInArrow(task, f"i int, home int, cells array<int>, size int, label string, id long, weight long, vec {kind}")


def _route(visits: DataFrame, parts: DataFrame, crowded: DataFrame) -> DataFrame:
    """visits dealt to blocks: half cells, or (divided) product cells or parts of those. crowded(size, label, i): the half
    cells that are divided; parts(size, label, i, j, n): product cells of those in more than one part."""
    marked = visits.join(crowded.withColumn("divided", F.lit(True)), ["size", "label", "i"], "left")
    whole = marked.where("divided is null").select("size", "label", "i", F.lit(-1).alias("j"), F.lit(0).cast("long").alias("s"), (F.col("home") < 0).alias("visitor"), "cells", "id", "weight", "vec")
    by_cell = marked.where("divided").withColumn("j", F.explode("cells")).join(parts, ["size", "label", "i", "j"], "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long")))
    mine = F.when(F.col("j") == F.col("home"), F.pmod("id", F.col("n")))
    dealt = by_cell.withColumn("mine", mine).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return whole.unionByName(
        dealt.select("size", "label", "i", "j", "s", (~F.coalesce(F.col("s") == F.col("mine"), F.lit(False))).alias("visitor"), F.array("j").alias("cells"), "id", "weight", "vec")
    ).withColumn("block", F.concat_ws("|", "size", "i", "j", "s", "label")).drop("size", "label", "i", "j", "s")


class _Block:
    """Home vectors of a block, and what has been found for them."""

    def __init__(self, ids: np.ndarray, weight: np.ndarray, x: np.ndarray, first: np.ndarray, least: float):
        """first: the product cell, by its second half, in which each vector is at home."""
        self.ids, self.x, self.least = ids, x, least
        self.links = weight - 1
        self.cells = {int(j): np.flatnonzero(first == j) for j in np.unique(first)}

    def meet(self, ids: np.ndarray, weight: np.ndarray, x: np.ndarray, cells: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Compare with vectors that visit cells here; links as (id, id) of spanning forests."""
        visited = cells.flatten().to_numpy()
        who = np.repeat(np.arange(len(ids)), np.diff(cells.offsets.to_numpy()))
        for j, own in self.cells.items():
            guests = who[visited == j]
            for begin in range(0, len(own), ROWS) if len(guests) else ():
                some = own[begin : begin + ROWS]
                hit = self.x[some] @ x[guests].T >= self.least
                hit &= self.ids[some][:, None] != ids[guests][None]
                if hit.any():
                    self.links[some] += hit @ weight[guests]
                    r, c = np.nonzero(hit)
                    yield forest(self.ids[some][r], ids[guests][c])


def _compare(routed: DataFrame, least: float) -> DataFrame:
    """(a, b null, n): a has n links; (a, b, n null): a and b are joined."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, homes, block = None, [], None

        def opened() -> _Block:
            ids, weight, x, first = (np.concatenate(v) for v in zip(*((*h[:3], h[3].flatten().to_numpy()[h[3].offsets.to_numpy()[:-1] - h[3].offsets[0].as_py()]) for h in homes), strict=True))
            return _Block(ids, weight, x, first, least)

        def edges(found) -> Iterator[pa.RecordBatch]:
            for a, b in found:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "n"])

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal block, homes
            if block is None and homes:
                block = opened()
                yield from edges(among())
            if block is not None:
                yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.nulls(len(block.ids), pa.int64()), pa.array(block.links)], names=["a", "b", "n"])
            block, homes = None, []

        def among():
            for held in homes:
                yield from block.meet(*held)

        for whole in batches:
            names = np.array(whole.column("block").to_pylist(), dtype=object)
            away = np.array(whole.column("visitor").to_pylist(), dtype=bool)
            ends = np.flatnonzero((names[1:] != names[:-1]) | (away[1:] != away[:-1])) + 1
            for begin, end in zip([0, *ends], [*ends, len(names)], strict=True):
                for start in range(begin, end, BATCH):
                    part = whole.slice(start, min(BATCH, end - start))
                    if names[start] != now:
                        yield from close()
                        now = names[start]
                    held = part.column("id").to_numpy(), part.column("weight").to_numpy(), _unit(_matrix(part.column("vec"))), part.column("cells")
                    if not away[start]:
                        homes.append(held)
                        continue
                    if not homes:
                        continue  # visitors of a cell where nothing is at home
                    if block is None:
                        block = opened()
                        yield from edges(among())
                    yield from edges(block.meet(*held))
        yield from close()

    return routed.repartition("block").sortWithinPartitions("block", "visitor").mapInArrow(task, "a long, b long, n long")


def _limit(x: np.ndarray, grid: Grid, least: float, recall: float, radius2: float) -> float:
    """The distance within which the cells of `recall` of all links of a sample are."""
    if recall >= 1:
        return radius2
    (i, lb), (j, lb2) = grid.bounds(x)
    found = []
    for at in range(0, len(x), ROWS):
        r, c = np.nonzero(x[at : at + ROWS] @ x.T >= least)
        r, c = r[r + at != c] + at, c[r + at != c]
        found.append(lb[r, i[c]] + lb2[r, j[c]])
    every = np.sort(np.concatenate(found))
    return min(radius2, float(every[math.ceil(recall * len(every)) - 1]) + 1e-12) if len(every) else radius2


def measured_recall(vectors: DataFrame, *, least: float = 0.98, recall: float = 0.9, every: int = 100) -> float:
    """The share of the link ends of the vectors whose id `every` divides that near_duplicates finds with this target;
    all links are those that recall 1 finds."""
    some = F.pmod("vec_id", F.lit(every)) == 0
    got, whole = (near_duplicates(vectors, least=least, recall=r).where(some).agg(F.sum("n_links")).first()[0] or 0 for r in (recall, 1.0))
    return got / whole if whole else 1.0


def near_duplicates(vectors: DataFrame, *, least: float = 0.98, recall: float = 1.0) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors(vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    nonzero = F.exists("embedding", lambda v: v != 0)
    keyed = rows.select(
        "vec_id", "embedding", "label",
        F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & nonzero, F.xxhash64("label", "embedding")).alias("k"),
        F.hash("embedding", "label").alias("k2"),
    )
    classes = stage(
        keyed.where("k is not null").groupBy("k", "k2").agg(
            F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first(F.col("label").cast("string")).alias("label"), F.first("embedding").alias("vec")
        ).withColumn("size", F.size("vec")), "vectors",
    )
    radius2 = 2 - 2 * least + 1e-6
    grids, limits = {}, {}
    for dim, n in classes.groupBy("size").count().collect():  # a row for each length
        of_dim = classes.where(F.col("size") == dim)
        drawn = of_dim.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))).select("vec").toArrow()
        if not drawn.num_rows:
            drawn = of_dim.limit(1).select("vec").toArrow()
        cells = 1 << max(2, min(10, math.ceil(math.log2(max(n / 8000, 1)))))
        sample = _unit(_matrix(drawn["vec"].combine_chunks()))
        grids[dim] = Grid(sample, cells)
        limits[dim] = _limit(sample, grids[dim], least, recall, radius2)
    visits = _visits(classes, grids, limits)
    crowd = _visits(classes, grids, dict.fromkeys(limits, -1.0)).select("size", "label", "i", F.col("home").alias("j"))  # homes only
    crowd = stage(crowd.groupBy("size", "label", "i", "j").count(), "cells")
    crowded = crowd.groupBy("size", "label", "i").agg(F.sum("count").alias("all")).where(F.col("all") > HOT).select("size", "label", "i")
    parts = crowd.where(F.col("count") > HOT).select("size", "label", "i", "j", F.ceil(F.col("count") / HOT).alias("n"))
    found = stage(_compare(_route(visits, parts, crowded), least), "links")
    components = connected_components(found.where("n is null").select("a", "b").distinct())
    of_class = (
        classes.select("k", "k2", "id").join(found.where("n is not null").select(F.col("a").alias("id"), "n"), "id", "left")
        .join(components, F.col("id") == F.col("node"), "left").select("k", "k2", "n", F.coalesce("root", "id").alias("root"))
    )
    return (
        keyed.select("vec_id", "k", "k2").join(of_class, ["k", "k2"], "left")
        .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )

