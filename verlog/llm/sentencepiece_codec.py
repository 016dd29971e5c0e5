"""SentencePiece encoding and decoding by a streaming Viterbi search.

At each character boundary the lattice keeps the best way to reach it and a backpointer, over a
window no longer than the longest piece. As soon as all ways that survive in the window go through
one boundary, the ids up to it are committed and forgotten, so memory does not grow with the text.

What "best" means is the model's own rule, so the ids equal the model's:
- unigram models: the greatest sum of scores;
- BPE models: the one segmentation that the merges produce. Merging is local: a segmentation is the
  merges' result exactly if each two neighbouring pieces are what the merges make of those two
  pieces' characters. So at each boundary one piece survives: the one that fits what survives where
  it begins.

An automaton of all pieces gives those that end at each place; every unit, short or long, goes
through this one lattice. Units lie between boundaries that no piece can reach across, where all ways
converge from the start (before a blank that follows another character, for one). They repeat all
the time; a cache of bounded size keeps their ids.

Defined cases: null text gives null ids; empty text gives no ids; very long texts, and long runs
without a boundary, stream through the window; repeated rows are encoded alike; other columns stay.
Characters without a piece become byte pieces, or the unknown id where the model has none; only the
latter do not decode to the same text.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
NONE = float("-inf")


class Codec:
    def __init__(self, model: str, bpe: bool = True, cache_words: int = 200_000, cache_chars: int = 64):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bpe = bpe
        n = self.sp.vocab_size()
        pieces = [self.sp.id_to_piece(i) for i in range(n)]
        special = [self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i) for i in range(n)]
        is_byte = [self.sp.is_byte(i) for i in range(n)]
        self.pieces = pieces
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i] and not is_byte[i]}
        self.scores = {p: self.sp.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if is_byte[i]}
        self.unknown = self.sp.unk_id()
        self.longest = max(map(len, self.ids), default=1)
        self.low = min(self.scores.values(), default=0.0) - 10.0
        # pieces that their own merges produce; others are never in a result
        self.sound = {p: i for p, i in self.ids.items() if not bpe or self.merge(p) == [p]}
        self.size_of = [*map(len, pieces), 1]  # the last, at -1, is that of a character without a piece
        self.score_of = [self.scores.get(p, self.low) for p in pieces]
        self.neighbours = {p[k : k + 2] for p in self.sound for k in range(len(p) - 1)}
        self.units = self._units()
        self.found = ahocorasick.Automaton()  # the pieces that end at each place, the longest first
        for p, i in self.sound.items():
            self.found.add_word(p, i)
        self.found.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.past_pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}  # by word without the blank before it; with a real blank before, by unit
        self.older: dict[str, bytes] = {}
        self.cache_words, self.cache_chars = cache_words, cache_chars
        # what a piece reads as; bytes over 127 as surrogates, which decode() turns into bytes again
        self.reads = [chr(b if b < 128 else 0xDC00 + b) if is_byte[i] and (b := int(p[3:5], 16)) >= 0 else p for i, p in enumerate(pieces)]
        self.high = np.array([is_byte[i] and int(p[3:5], 16) > 127 for i, p in enumerate(pieces)])

    # --- normalisation: blanks are marked and one is put before the text

    def normalise(self, text: str) -> str:
        return BLANK + text.replace(" ", BLANK) if text else ""

    def _units(self) -> re.Pattern | None:
        """Cuts a text where no piece can reach across: there all ways converge whatever the rest is.

        `alone` are signs with no neighbour in any piece; `after` are signs that follow letters or digits in
        some piece, other signs begin a unit there. None if some piece has a blank after another character."""
        if any(BLANK in p.lstrip(BLANK) for p in self.sound):
            return None
        signs = {c for p in self.sound for c in p if not c.isalnum() and c != BLANK} | set("\n\r\t")
        alone = {c for c in signs if not any(c in xy for xy in self.neighbours)}
        after = {xy[1] for xy in self.neighbours if xy[0].isalnum() and xy[1] in signs}
        a, h = (re.escape("".join(sorted(s))) for s in (alone, after))
        sign, word = rf"[^{BLANK}{a}\w]|_", r"[^\W_]++"
        rest = rf"(?:{sign})*+(?:{word}" + (rf"(?:[{h}](?:{sign})*+)?+" if h else "") + ")"
        return re.compile(rf"{BLANK}++{rest}*+" + (f"|[{a}]" if a else "") + rf"|{rest}++|(?:{sign})++")

    # --- the rule of BPE models

    def merge(self, text: str) -> list[str]:
        """What the merges make of a short text: the best-scored neighbours first, leftmost of equals."""
        part, scores = list(text), self.scores
        joint = [scores.get(x + y, NONE) for x, y in zip(part, part[1:])]
        while joint and (most := max(joint)) > NONE:
            k = joint.index(most)
            part[k : k + 2] = [part[k] + part[k + 1]]
            del joint[k]
            if k:
                joint[k - 1] = scores.get(part[k - 1] + part[k], NONE)
            if k < len(joint):
                joint[k] = scores.get(part[k] + part[k + 1], NONE)
        return part

    def _fits(self, before: int, piece: int) -> bool:
        """Whether the merges leave these two pieces next to each other."""
        if len(self.pairs) >= 150_000:
            self.past_pairs = self.pairs.copy()
            self.pairs.clear()
        key = before * len(self.pieces) + piece
        fits = self.past_pairs.get(key)
        if fits is None:
            a, b = self.pieces[before], self.pieces[piece]
            fits = a[-1] + b[0] not in self.neighbours or self.merge(a + b) == [a, b]
        self.pairs[key] = fits
        return fits

    # --- the lattice

    def lattice(self, text: str, commit: Callable[[list[int]], None], window: int | None = None) -> None:
        """Hands runs of piece ids (-1: a character without a piece) to commit, each as soon as it is certain.

        last (and for sums best) belong to the boundaries from `begun` on, which is committed."""
        window, base, get, size_of = window or self.longest, len(self.pieces), self.pairs.get if self.bpe else None, self.size_of
        begun, size, room = 0, len(text), min(len(text), 4 * window)
        last = [-1] * (room + 1)  # the piece that ends at a boundary
        best = [0.0]  # of models by sums
        done = 0  # the boundary whose one way is known (BPE models)
        for at, piece in self.found.iter(text):
            end = at + 1 - begun
            if end == done:
                continue
            if end > room:
                # the ways that can go on are those to boundaries that a coming piece may begin at
                meet = self._meeting(last, end - 1, window)
                if meet:
                    commit(self._trace(last, meet))
                    begun, end, done = begun + meet, end - meet, done - meet
                    last, best = last[meet:], best[meet:]
                    last[0] = last[0] if get else -1
                room = max(len(last) - 1, end + 3 * window)
                last += [-1] * (room + 1 - len(last))
            if get:
                before = last[end - size_of[piece]]
                # a character without a piece, or the beginning, has nothing to merge with
                if before >= 0:
                    fits = get(before * base + piece)
                    if fits is None:
                        fits = self._fits(before, piece)
                    if not fits:
                        continue
                last[end], done = piece, end
            else:
                while len(best) <= end:  # a way by a single character, until there is a better one
                    best.append(best[-1] + self.low)
                if (score := best[end - size_of[piece]] + self.score_of[piece]) > best[end] or last[end] < 0:
                    last[end], best[end] = piece, score
        commit(self._trace(last + [-1] * (size - begun + 1 - len(last)), size - begun))

    def _meeting(self, last: list[int], at: int, window: int) -> int:
        """The last boundary that the ways to all of the last `window` boundaries up to `at` have in common."""
        ends = set(range(at - window, at + 1))
        while len(ends) > 1:
            end = max(ends)
            ends.remove(end)
            ends.add(end - self.size_of[last[end]])
        return ends.pop()

    def _trace(self, last: list[int], end: int) -> list[int]:
        out, size_of = [], self.size_of
        while end > 0:
            piece = last[end]
            out.append(piece)
            end -= size_of[piece]
        out.reverse()
        return out

    def segment(self, text: str, window: int | None = None) -> Iterator[str]:
        """The pieces of a normalised text, given out as soon as they are certain."""
        runs: list[int] = []
        self.lattice(text, runs.extend, window)
        at = 0
        for piece in runs:
            yield text[at : at + self.size_of[piece]]
            at += self.size_of[piece]

    # --- ids

    def _ids_of(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        if self.byte_ids:
            return [self.byte_ids[b] for b in piece.encode()]
        return [self.unknown]

    def _unit(self, unit: str) -> bytes:
        ids: list[int] = []
        self.lattice(unit, ids.extend)
        if -1 in ids:
            at, known, ids = 0, ids, []
            for piece in known:
                ids += [piece] if piece >= 0 else self._ids_of(unit[at])
                at += self.size_of[piece]
        return struct.pack(f"<{len(ids)}i", *ids)

    def _word(self, word: str) -> bytes:
        """The ids of a word and the blank before it, or of a unit after a real blank; words.get didn't have them."""
        got = self.older.get(word)
        if got is None:
            if word[0] == " ":
                got = self._unit(word[1:])
            elif word.isalnum() or len(units := self.units.findall(BLANK + word)) == 1:
                got = self._unit(BLANK + word)
            else:
                get, make = self.words.get, self._word
                keys = [u[1:] if u[0] == BLANK and u[1:2] not in ("", BLANK) else " " + u for u in units]
                got = b"".join([get(k) or make(k) for k in keys])
        if len(word) <= self.cache_chars:
            if len(self.words) >= self.cache_words:
                self.older = self.words.copy()
                self.words.clear()
            self.words[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian int32."""
        if not text:
            return b""
        if self.units is None:
            return self._unit(self.normalise(text))
        words = text.split(" ")
        if "" in words or BLANK in text:  # runs of blanks belong together
            words = [" " + u for u in self.units.findall(self.normalise(text))]
        get, make = self.words.get, self._word
        return b"".join([get(w) or make(w) for w in words])

    def decode(self, ids: list[int]) -> str:
        text = "".join(map(self.reads.__getitem__, ids))
        if len(ids) and self.high[ids].any():
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text.replace(BLANK, " ")[1:]


@functools.lru_cache(2)
def codec(model: str) -> Codec:
    return Codec(model)


def encode(df: DataFrame, *, text_col: str = "text", model: str = MODEL, verify: bool = False) -> DataFrame:
    """df without its text, with ids added (in place of columns of these names); verify also adds round_trip: whether decoding the ids
    gives the text. `▁` itself reads back as a blank; such texts are the ones that differ."""
    kept = [(c, t) for c, t in df.dtypes if c not in (text_col, "ids", "round_trip")]
    named = [*(c for c, _ in kept), "ids", *(["round_trip"] if verify else [])]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                blobs, same = [], []
                for _, text in texts(batch.column(text_col)):
                    blobs.append(None if text is None else own.encode(text))
                    if verify:
                        same.append(None if text is None else own.decode(np.frombuffer(blobs[-1], "<i4")) == text)
                ends = np.concatenate(([0], np.cumsum([len(b or b"") // 4 for b in blobs])))
                values = pa.array(np.frombuffer(b"".join(b or b"" for b in blobs), "<i4"), pa.int32())
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([b is None for b in blobs]))
                more = [pa.array(same, pa.bool_())] if verify else []
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c, _ in kept), ids, *more], names=named)
        own.older, own.past_pairs = {}, {}
        give_back()

    schema = "".join(f"`{c}` {t}, " for c, t in kept)
    return df.mapInArrow(task, f"{schema}ids array<int>{', round_trip boolean' if verify else ''}")


def decode(df: DataFrame, *, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """df without its ids, with text added (in place of a column text); null ids give null text."""
    kept = [(c, t) for c, t in df.dtypes if c not in (ids_col, "text")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [None if i is None else own.decode(i) for i in batch.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c, _ in kept), pa.array(found, pa.string())], names=[*(c for c, _ in kept), "text"])

    return df.mapInArrow(task, "".join(f"`{c}` {t}, " for c, t in kept) + "text string")


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids and round_trip of every document."""
    done = encode(docs.select("doc_id", "text"), model=model, verify=True)
    return done.select("doc_id", F.expr("if(ids is null, null, size(ids))").cast("long").alias("n_ids"), "ids", "round_trip")
