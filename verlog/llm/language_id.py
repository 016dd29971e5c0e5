"""Multilingual mixture inference by expectation-maximisation over character n-grams.

Each learned language is a distribution over hashed character trigrams of lower-cased text, in which
every run of other characters than letters counts as one blank. A document's trigrams are a mixture
of the languages; EM estimates the proportions. The set of languages is chosen by penalised
likelihood: starting from the best single language, the one that raises the likelihood most joins
while the gain exceeds `penalty` times ln(trigrams).

The counts cover every labelled document. What reaches the driver is one count for each language and
slot, so its bound is the number of languages times SLOTS.

Defined cases: null text, or text without a letter, gives 'und' with score 0; with nothing to learn
from, every document is 'und'; ties go to the language first in order; long texts are counted in
overlapping slices; repeated rows are judged alike; other columns are ignored, those named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, texts

SLOTS = 1 << 13
SLICE = 1 << 20
UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")


def words_of(text: str | None) -> str:
    """The letters of a text, lower-cased, with a blank for all that is between and around them; empty if there are none."""
    words = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if not words.replace(" ", "").isalpha():  # numeric signs, such as fractions and Roman numerals, are left
        words = " ".join("".join(c if c.isalpha() else " " for c in words).split())
    return f" {words} " if words else ""


def slots_of(text: str | None) -> np.ndarray:
    """The slot of each trigram of a text; empty if it has no letter."""
    return np.concatenate([np.zeros(0, np.int64), *_slices(text)])


def _slots(words: str) -> np.ndarray:
    code = np.frombuffer(words.encode("utf-32-le"), dtype=np.uint32)
    mixed = (code[:-2] * np.uint32(0x9E3779B1) + code[1:-1]) * np.uint32(0x85EBCA77) + code[2:]
    return ((mixed * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - SLOTS.bit_length() + 1)).astype(np.int64)


def _slices(text: str | None) -> Iterator[np.ndarray]:
    """The slots of a text's trigrams, SLICE at a time; slices overlap by two characters, so they are those of the whole."""
    words = words_of(text)
    for at in range(0, len(words) - 2, SLICE):
        yield _slots(words[at : at + SLICE + 2])


def count_trigrams(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages in order, and their counts by slot, over all rows of labelled(text, lang)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for i, text in texts(batch.column("text")):
                own = counts.setdefault(langs[i], np.zeros(SLOTS, np.int64))
                for slots in _slices(text):
                    own += np.bincount(slots, minlength=SLOTS)
        give_back()
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "slot": pa.array(at), "n": pa.array(n[at])})

    table = labelled.select("text", "lang").mapInArrow(task, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(table["lang"].to_pylist(), dtype=object)
    langs = sorted(set(names.tolist()))
    out = np.zeros((len(langs), SLOTS))
    for k, lang in enumerate(langs):
        mine = names == lang
        out[k, table["slot"].to_numpy()[mine]] = table["n"].to_numpy()[mine]
    return langs, out


def mixtures(likelihood: np.ndarray, counts: np.ndarray, first: np.ndarray, chosen: np.ndarray, rounds: int = 30, tolerance: float = 1e-3) -> np.ndarray:
    """EM proportions of many documents at once.

    likelihood: a row for each (document, slot), a column for each language; counts: how often the
    slot occurs; first: each document's first row; chosen: document by language, what may take part.
    """
    share = chosen / chosen.sum(1, keepdims=True)
    sizes = np.diff(np.append(first, len(counts)))
    live, rows = np.arange(len(first)), np.arange(len(counts))
    for _ in range(rounds):
        begin = np.concatenate(([0], np.cumsum(sizes[live])[:-1])).astype(np.int64)
        part = likelihood[rows] * np.repeat(share[live], sizes[live], axis=0)
        part *= (counts[rows] / part.sum(1))[:, None]
        new = np.add.reduceat(part, begin, axis=0)
        new /= new.sum(1, keepdims=True)
        moved = np.abs(new - share[live]).max(1)
        share[live] = new
        still = moved > tolerance
        if not still.any():
            break
        rows = rows[np.repeat(still, sizes[live])]
        live = live[still]
    return share


def _fit(likelihood: np.ndarray, counts: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Proportions of each document over the languages that penalised likelihood selects."""
    docs, n_lang = len(first), likelihood.shape[1]
    sizes = np.diff(np.append(first, len(counts)))
    total = np.add.reduceat(counts, first)
    single = np.add.reduceat(np.log(likelihood) * counts[:, None], first, axis=0)
    chosen = np.zeros((docs, n_lang))
    chosen[np.arange(docs), single.argmax(1)] = 1
    share, best = chosen.copy(), single.max(1)
    open_ = np.arange(docs)
    for _ in range(1, n_lang):
        if not len(open_):
            break
        rows = np.flatnonzero(np.isin(np.repeat(np.arange(docs), sizes), open_))
        begin = np.concatenate(([0], np.cumsum(sizes[open_])[:-1])).astype(np.int64)
        lik, n = likelihood[rows], counts[rows]
        now = (lik * np.repeat(share[open_], sizes[open_], axis=0)).sum(1)
        # how the likelihood rises at first as each language that is left out takes a share
        slope = np.add.reduceat(lik * (n / now)[:, None], begin, axis=0) / total[open_][:, None]
        slope[chosen[open_] > 0] = 0
        add = slope.argmax(1)
        trial = chosen[open_]
        trial[np.arange(len(open_)), add] = 1
        may = slope.max(1) > 1  # else no share of it raises the likelihood
        if not may.any():
            break
        pick = np.repeat(may, sizes[open_])
        begin = np.concatenate(([0], np.cumsum(sizes[open_][may])[:-1])).astype(np.int64)
        got = mixtures(lik[pick], n[pick], begin, trial[may])
        value = np.add.reduceat(np.log((lik[pick] * np.repeat(got, sizes[open_][may], axis=0)).sum(1)) * n[pick], begin)
        who = open_[may]
        better = value - best[who] > penalty * np.log(np.maximum(total[who], 2))
        who = who[better]
        share[who], best[who], chosen[who] = got[better], value[better], trial[may][better]
        open_ = who
    return share


class Judge:
    """What has been learned, as judge of texts."""

    def __init__(self, langs: list[str], counts: np.ndarray, penalty: float = 4.0, batch_chars: int = 200_000):
        smooth = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True) if len(langs) else counts
        self.langs, self.table, self.penalty, self.batch_chars = langs, np.ascontiguousarray(smooth.T), penalty, batch_chars

    def _fit(self, held: list[np.ndarray]) -> np.ndarray:
        cell = [np.flatnonzero(h) for h in held]
        first = np.concatenate(([0], np.cumsum([len(c) for c in cell])[:-1])).astype(np.int64)
        n = np.concatenate([h[c] for h, c in zip(held, cell, strict=True)]).astype(float)
        return _fit(self.table[np.concatenate(cell)], n, first, self.penalty)

    def proportions(self, column: pa.Array) -> np.ndarray:
        """A row for each text; zeros where nothing can be told."""
        share = np.zeros((len(column), len(self.langs)))
        at, held, size = [], [], 0
        for i, text in texts(column) if self.langs else ():
            n = None
            for slots in _slices(text):
                if len(slots):
                    n = np.bincount(slots, minlength=SLOTS) + (0 if n is None else n)
            if n is None:
                continue
            at.append(i)
            held.append(n)
            size += len(text)
            if size >= self.batch_chars or len(held) >= 128:
                share[at] = self._fit(held)
                at, held, size = [], [], 0
        if held:
            share[at] = self._fit(held)
        return share


def predict(docs: DataFrame, judge: Judge) -> DataFrame:
    """lang_pred, score (the proportion of lang_pred) and proportions (by language) in place of the text
    of docs, and of columns of these names."""
    kept, langs = [(c, t) for c, t in docs.dtypes if c.lower() not in ("text", "lang_pred", "score", "proportions")], judge.langs

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = judge.proportions(batch.column("text"))
            best = share.argmax(1) if langs else np.zeros(batch.num_rows, int)
            score = share.max(1) if langs else np.zeros(batch.num_rows)
            names = [langs[b] if s > 0 else UNKNOWN for b, s in zip(best, score, strict=True)]
            parts = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(langs), pa.int32()), pa.array(share.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c, _ in kept), pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0)), parts],
                names=[*(c for c, _ in kept), "lang_pred", "score", "proportions"],
            )

    schema = "".join(f"`{c}` {t}, " for c, t in kept)
    return docs.mapInArrow(task, f"{schema}lang_pred string, score double, proportions array<double>")


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Learn from text and lang of the documents that are not held out."""
    return count_trigrams(docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("text", "lang"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and proportions of every document."""
    marked = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return predict(marked, Judge(*learn(docs)))


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents, all columns kept, with letters and a language that makes up at least `least` of them."""
    judge = Judge(*learn(docs))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):  # what is returned is a copy, so little at a time
                batch = whole.slice(at, 512)
                share = judge.proportions(batch.column("text"))
                yield batch.filter(pa.array(share.max(1, initial=0.0) >= least))
        give_back()

    return docs.mapInArrow(task, docs.schema)
