"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

Test items are cut into segments of at most SEGMENT words and indexed with their BM25 impacts, each
divided by the score of the segment against itself: a passage with all words of a segment scores 1.
Every training document is cut into passages of 2 * SEGMENT words, SEGMENT apart, so that a segment
that a document quotes lies within one passage. Each passage is a query for all segments that score
at least `least`.

Passages are first bounded together, by the essential terms of each segment: nearly all lack them.
The rest go through WAND with block maxima. What is found is verified in the
text around the passage: at least `overlap` of the word pairs of the question, and as many of the
answer, must occur there. The answer is what follows the last question mark; without one, the last
line; without lines, the last sentence; else the last third.

Items are indexed INDEX_ITEMS or INDEX_CHARS at a time (the bound of what is broadcast); each such
index meets all documents. Document frequencies and the mean length of segments are those of all
items, so scores do not depend on which index an item is in.

Defined cases: null or wordless texts match nothing; an item without words or id is never found; an item
of one word is its own pair; ties are kept; repeated rows give repeated results; empty tables give
no rows (no items: no document is dropped); other columns of documents stay in the filter.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, stage, texts

SEGMENT, BLOCK = 64, 8
INDEX_ITEMS, INDEX_CHARS = 20_000, 10_000_000
K1, B = 1.2, 0.75
#: ASCII characters other than letters and digits end a word
BLANKED = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(BLANKED).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    for pattern in (r"(?s)^(.*\?)(.*)$", r"(?s)^(.*)\n(.*)$", r"(?s)^(.*[.!])(?=\s)(.*)$"):
        if (m := re.match(pattern, text.strip())) and words_of(m[1]) and words_of(m[2]):
            return words_of(m[1]), words_of(m[2])
    w = words_of(text)
    return w[: len(w) - len(w) // 3], w[len(w) - len(w) // 3 :]


def pairs_of(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return set(zip(words, words[1:])) if len(words) > 1 else {tuple(words)} if words else set()


class Index:
    """Impacts by term, in segment order, with their maxima by block of BLOCK segments."""

    def __init__(self, items: list[tuple[int, str]], n_items: int, frequency: dict[bytes, int], least: float, overlap: float, mean: float | None = None):
        """mean: the mean length of the segments of all items; without it, of these."""
        self.least, self.overlap = least, overlap
        self.items = {i: (question_and_answer(t), len(words_of(t))) for i, t in items}
        segments = [(i, w[at : at + SEGMENT]) for i, t in items if (w := words_of(t)) for at in range(0, len(w), SEGMENT)]
        self.of = [i for i, _ in segments]
        if mean is None:
            mean = sum(len(w) for _, w in segments) / max(len(segments), 1)
        self.term: dict[bytes, int] = {}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for d, (_, w) in enumerate(segments):
            count: dict[bytes, int] = defaultdict(int)
            for x in w:
                count[x] += 1
            impact = {
                x: math.log(1 + (n_items - frequency[x] + 0.5) / (frequency[x] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / mean))
                for x, n in count.items()
            }
            own = sum(impact.values())
            for x, v in impact.items():
                postings[self.term.setdefault(x, len(self.term))].append((d, v / own))
        self.docs = [[d for d, _ in postings[t]] for t in range(len(self.term))]
        self.impacts = [[v for _, v in postings[t]] for t in range(len(self.term))]
        self.top = [max(v) for v in self.impacts]
        self.blocks: list[dict[int, float]] = []
        # a segment's key terms are its strongest, such that the others together score at most half of
        # `least`: a passage can only find it by key terms that score the rest
        self.rest = np.zeros(len(segments))
        key: dict[int, list[tuple[int, float]]] = defaultdict(list)
        by_segment: dict[int, list[tuple[float, int]]] = defaultdict(list)
        for t, (ds, vs) in enumerate(zip(self.docs, self.impacts, strict=True)):
            most: dict[int, float] = {}
            for d, v in zip(ds, vs, strict=True):
                most[d // BLOCK] = max(most.get(d // BLOCK, 0.0), v)
                by_segment[d].append((v, t))
            self.blocks.append(most)
        for d, terms in by_segment.items():
            for v, t in sorted(terms):
                if self.rest[d] + v <= least / 2:
                    self.rest[d] += v
                else:
                    key[t].append((d, v))
        self.key_first = np.cumsum([0, *(len(key[t]) for t in range(len(self.term)))])
        self.key_segment = np.array([d for t in range(len(self.term)) for d, _ in key[t]], dtype=np.int64)
        self.key_impact = np.array([v for t in range(len(self.term)) for _, v in key[t]])

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All segments that score at least `least` for these distinct terms."""
        least, docs, out = self.least - 1e-9, self.docs, []
        at = dict.fromkeys(terms, 0)
        live = sorted(terms, key=lambda t: docs[t][0])
        while live:
            bound, pivot = 0.0, None
            for k, t in enumerate(live):
                bound += self.top[t]
                if bound >= least:
                    pivot = docs[t][at[t]]
                    break
            if pivot is None:
                return out
            last = k
            while last + 1 < len(live) and docs[live[last + 1]][at[live[last + 1]]] == pivot:
                last += 1
            block = pivot // BLOCK
            if sum(self.blocks[t].get(block, 0.0) for t in live[: last + 1]) < least:
                # nothing in this block up to the next term's place can score enough
                to = (block + 1) * BLOCK
                if last + 1 < len(live):
                    to = min(to, docs[live[last + 1]][at[live[last + 1]]])
                to = max(to, pivot + 1)
                moved = live[: last + 1]
            elif docs[live[0]][at[live[0]]] == pivot:
                score = sum(self.impacts[t][at[t]] for t in live[: last + 1])
                if score >= least:
                    out.append((pivot, score))
                to, moved = pivot + 1, live[: last + 1]
            else:
                to, moved = pivot, [t for t in live[: last + 1] if docs[t][at[t]] < pivot]
            for t in moved:
                at[t] = bisect.bisect_left(docs[t], to, at[t])
            live = sorted((t for t in live if at[t] < len(docs[t])), key=lambda t: docs[t][at[t]])
        return out

    def verified(self, item: int, around: set[tuple[bytes, ...]]) -> tuple[float, float]:
        """The shares of the word pairs of question and answer that occur around a passage."""
        shares = []
        for part in self.items[item][0]:
            pairs = pairs_of(part)
            shares.append(len(pairs & around) / len(pairs) if pairs else 1.0)
        return shares[0], shares[1]

    def candidates(self, docs: list[np.ndarray]) -> list[tuple[int, int]]:
        """(document, passage) of the passages whose key terms do not rule them out. docs: terms by place, -1 for others."""
        blocks = [-(-len(d) // SEGMENT) for d in docs]
        base = np.concatenate(([0], np.cumsum([b + 1 for b in blocks])))  # a gap between documents
        place = np.concatenate([np.arange(len(d)) // SEGMENT + b for d, b in zip(docs, base[:-1], strict=True)])
        flat = np.concatenate(docs)
        known = np.flatnonzero(flat >= 0)
        size = np.diff(self.key_first)
        known = known[size[flat[known]] > 0]
        found = np.unique(place[known] * len(self.term) + flat[known])
        term, n = found % len(self.term), size[found % len(self.term)]
        # the segments of each term, as rows
        row = np.repeat(self.key_first[term] - np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64), n) + np.arange(n.sum())
        block, segment, impact = np.repeat(found // len(self.term), n), self.key_segment[row], self.key_impact[row]
        # a block belongs to the passage that begins with it and to the one before
        cell = np.concatenate((block, block - 1)) * len(self.of) + np.concatenate((segment, segment))
        cell, where = np.unique(cell, return_inverse=True)
        score = np.bincount(where, np.concatenate((impact, impact)), len(cell)) + self.rest[cell % len(self.of)]
        hit = np.unique(cell[score >= self.least - 1e-6] // len(self.of))
        owner = np.searchsorted(base, hit, side="right") - 1
        return [(int(o), int(h - base[o])) for o, h in zip(owner, hit, strict=True) if o >= 0 and h - base[o] < blocks[o]]

    def matches(self, words: list[list[bytes]]) -> list[dict[int, tuple[float, float, float]]]:
        """For each document {item: (score, question share, answer share)} of what is verified."""
        out: list[dict] = [{} for _ in words]
        if not self.term:
            return out
        ids = [np.fromiter(map(self.term.get, ws, itertools.repeat(-1)), np.int64, len(ws)) for ws in words]
        for d, p in self.candidates(ids) if any(map(len, ids)) else ():
            own = ids[d][p * SEGMENT : (p + 2) * SEGMENT]
            best: dict[int, float] = {}
            for segment, score in self.search(np.unique(own[own >= 0]).tolist()):
                best[self.of[segment]] = max(score, best.get(self.of[segment], 0.0))
            for item, score in best.items():
                reach = self.items[item][1]
                around = pairs_of(words[d][max(0, p * SEGMENT - reach) : (p + 2) * SEGMENT + reach])
                if self.items[item][1] == 1:
                    around |= {(w,) for w in words[d][p * SEGMENT : (p + 2) * SEGMENT]}
                around |= {(w,) for part in self.items[item][0] if len(part) == 1 for w in words[d][max(0, p * SEGMENT - reach) : (p + 2) * SEGMENT + reach] if w == part[0]}
                shares = self.verified(item, around)
                if min(shares) >= self.overlap:
                    out[d][item] = max(out[d].get(item, (0.0, 0.0, 0.0)), (score, *shares))
        return out


def build_indexes(benchmark: DataFrame, least: float, overlap: float, per_index: int = INDEX_ITEMS) -> Iterator[Index]:
    """An index for each per_index items; the driver holds one at a time, and the frequencies of its words. Those are
    counted once, over all items, and stay in the cluster."""
    items = benchmark.where("text is not null and item_id is not null").select("item_id", "text")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = words = segments = 0
        for batch in batches:
            for _, text in texts(batch.column("text")):
                size = len(words_of(text))
                n, words, segments = n + 1, words + size, segments + -(-size // SEGMENT)
        yield pa.RecordBatch.from_pydict({"n": [n], "words": [words], "segments": [segments]})

    total = items.select("text").mapInArrow(lengths, "n long, words long, segments long").agg(F.sum("n"), F.sum("words"), F.sum("segments")).first()
    n_items, mean = total[0] or 0, (total[1] or 0) / max(total[2] or 0, 1)
    held: list[tuple[int, str]] = []
    size = 0

    def vocabularies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for _, text in texts(batch.column("text")):
                for w in set(words_of(text)):
                    count[w] += 1
            if len(count) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["w", "n"])
                count.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["w", "n"])

    frequency = stage(items.select("text").mapInArrow(vocabularies, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")), "frequencies") if n_items else None

    def make() -> Index:
        vocabulary = sorted({w for _, t in held for w in words_of(t)})
        own = frequency.join(F.broadcast(benchmark.sparkSession.createDataFrame([(w,) for w in vocabulary], "w binary")), "w") if vocabulary else None
        return Index(held, n_items, {bytes(r.w): r.n for r in own.collect()} if own is not None else {}, least, overlap, mean)

    for row in items.toLocalIterator():
        held.append((row.item_id, row.text))
        size += len(row.text)
        if len(held) == per_index or size >= INDEX_CHARS:
            yield make()
            held, size = [], 0
    if held:
        yield make()


def _by_batch(index: Index, column: pa.Array, chars: int = 400_000) -> Iterator[tuple[int, dict]]:
    """(row, matches) of a text column, about `chars` characters at a time."""
    rows, held, size = [], [], 0
    for i, text in texts(column):
        rows.append(i)
        held.append(words_of(text))
        size += len(text or "")
        if size >= chars:
            yield from zip(rows, index.matches(held), strict=True)
            rows, held, size = [], [], 0
    if rows:
        yield from zip(rows, index.matches(held), strict=True)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every verified match."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = None
    for index in build_indexes(benchmark, least, overlap):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # of INDEX_ITEMS items at most

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[i], item, *found) for i, got in _by_batch(shared.value, batch.column("text")) for item, found in sorted(got.items())]
                if rows:
                    c = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), *(pa.array(x, pa.float64()) for x in c[2:])],
                                                     names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = docs.select("doc_id", "text").mapInArrow(task, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """The documents without a verified match, with all their columns."""
    for index in build_indexes(benchmark, least, overlap):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):  # what is returned is a copy, so little at a time
                    batch = whole.slice(at, 512)
                    clean = [not got for _, got in _by_batch(shared.value, batch.column("text"))]
                    yield batch.filter(pa.array(clean, pa.bool_()))
            give_back()

        docs = docs.mapInArrow(task, docs.schema)
    return docs
