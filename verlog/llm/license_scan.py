"""Licence scans: notices and licence files are matched to templates by the cosine of sparse TF-IDF
vectors, and files without a notice inherit from the nearest directory above them that has one.

A text is cut into sentences (at line ends and sentence ends, MAX_WORDS words at most). Single
sentences and runs of them that begin and end with a key term of some template, no longer than the
longest template needs, are compared with every template. So is, for each template, every window of
as many words as it has, wherever in the text it begins: a notice quoted word for word scores 1 in the
middle of a sentence and across line ends. An upper bound of the cosine, from running sums, passes over
windows that can't reach the threshold or the best so far. Key terms of a template are its heaviest:
without any of them no vector reaches the threshold, so whole texts are passed over at set speed and
nothing is missed. Both sides are weighed by document frequencies, counted over all files: those of template words
one by one, those of other words in a table of 2^SLOT_BITS slots. Words that share a slot count together, on average as
many as a file has words for each slot, so that words rarer than that weigh alike at every number of files.

A licence file is one named LICENSE, LICENCE, COPYING or NOTICE, with any ending. Inheritance works
on distinct directories: their ancestors are joined to directories' licences by path, so a directory
with very many files is one row there.

Defined cases: null text has no notice; a null path has no directory and inherits nothing; with ties
the better score, then the first template, then the first path wins; repeated rows give repeated
results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, texts
from .decontaminate import words_of

#: Licence ids, notices and headings of licence files as their publishers word them. A notice that
#: begins with all of another's words stands before it.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED AS IS"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
MAX_WORDS = 64
SLOT_BITS = 16
SPAN = 50_000  # words of a text that are weighed at once
SENTENCE = re.compile(r"\n+|(?<=[.!?;])\s+")
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([-._].*)?$"


def slot_of(word: bytes) -> int:
    return zlib.crc32(word) >> (32 - SLOT_BITS)


class _Weights(dict):
    """The weight of each word; forgets words outside the templates when there are too many."""

    def __init__(self, known: dict[bytes, float], n_files: int, slots: np.ndarray | None):
        super().__init__(known)
        self.known, self.n_files, self.slots = known, n_files, slots

    def __missing__(self, word: bytes) -> float:
        if len(self) > 100_000:
            self.clear()
            self.update(self.known)
        found = 0 if self.slots is None else min(int(self.slots[slot_of(word)]), self.n_files)
        self[word] = w = math.log((1 + self.n_files) / (1 + found)) + 1
        return w

    def __reduce__(self):
        return _Weights, (self.known, self.n_files, self.slots)


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], n_files: int, frequency: dict[bytes, int], least: float, slots: np.ndarray | None = None):
        """frequency: files by template word; slots: files by slot of other words (without, they weigh as the rarest)."""
        self.least, self.names = least, [n for n, _ in templates]
        counts = [Counter(words_of(t)) for _, t in templates]
        self.longest = max(sum(c.values()) for c in counts)
        self.idf = {w: math.log((1 + n_files) / (1 + frequency.get(w, 0))) + 1 for c in counts for w in c}
        self.weights = _Weights(self.idf, n_files, slots)
        self.sizes = [sum(c.values()) for c in counts]
        self.vectors: list[dict[bytes, float]] = []
        self.keys: set[bytes] = set()
        self.keys_of: list[set[bytes]] = []
        for c in counts:
            v = {w: n * self.idf[w] for w, n in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            v = {w: x / norm for w, x in v.items()}
            self.vectors.append(v)
            rest = 0.0
            self.keys_of.append(set())
            for w, x in sorted(v.items(), key=lambda e: (e[1], e[0])):
                if math.sqrt(rest + x * x) < least:
                    rest += x * x
                else:
                    self.keys_of[-1].add(w)
            self.keys |= self.keys_of[-1]
        # by place of a template word; the last is any other word
        self.place = {w: i for i, w in enumerate(self.idf)}
        self.parts = [np.array([*(v.get(w, 0.0) * x for w, x in self.idf.items()), 0.0]) for v in self.vectors]

    def match(self, words: list[bytes]) -> tuple[float, int] | None:
        """The best cosine that reaches the threshold, and minus its template's place."""
        c = Counter(words)
        v = {w: n * self.weights[w] for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        found = [(sum(x * v.get(w, 0.0) for w, x in t.items()) / norm, -k) for k, t in enumerate(self.vectors)]
        best = max(((round(s, 9), k) for s, k in found), default=(0.0, 0))
        return best if best[0] >= self.least else None

    def _cosine(self, k: int, words: list[bytes]) -> float:
        v = {w: n * self.weights[w] for w, n in Counter(words).items()}
        return sum(x * v.get(w, 0.0) for w, x in self.vectors[k].items()) / math.sqrt(sum(x * x for x in v.values()))

    def _windows(self, words: list[bytes], best: tuple[float, int] | None) -> tuple[float, int] | None:
        """The best of `best` and of the windows of each template's number of words."""
        for at in range(0, len(words), SPAN):
            own = words[at : at + SPAN + self.longest - 1]  # windows that begin in the span end here
            has = set(own)
            ids = np.fromiter(map(self.place.get, own, itertools.repeat(-1)), np.int64, len(own))
            norms = np.concatenate(([0.0], np.cumsum(np.fromiter(map(self.weights.__getitem__, own), float, len(own)) ** 2)))
            for k, size in enumerate(self.sizes):
                if size > len(own) or self.keys_of[k].isdisjoint(has):
                    continue
                dots = np.concatenate(([0.0], np.cumsum(self.parts[k][ids])))
                # repeated words make the norm larger than this, never smaller; 1e-6 is for rounding
                most = np.minimum((dots[size:] - dots[:-size]) / np.sqrt(norms[size:] - norms[:-size]) + 1e-6, 1.0)
                starts = np.flatnonzero(most >= self.least)
                seen = set()
                for x in starts[np.argsort(-most[starts], kind="stable")].tolist():
                    if best and (most[x], -k) <= best:
                        break
                    key = tuple(own[x : x + size])
                    if key not in seen:
                        if len(seen) > 10_000:
                            seen.clear()
                        seen.add(key)
                        got = (round(self._cosine(k, own[x : x + size]), 9), -k)
                        if got[0] >= self.least and (best is None or got > best):
                            best = got
        return best

    def scan(self, text: str | None) -> tuple[str, float] | None:
        """The licence of a text's best notice and its cosine."""
        if not text or self.keys.isdisjoint(words_of(text)):
            return None
        parts = []
        for s in SENTENCE.split(text):
            w = words_of(s)
            parts += [w[k : k + MAX_WORDS] for k in range(0, len(w), MAX_WORDS)]
        hits = [k for k, w in enumerate(parts) if not self.keys.isdisjoint(w)]
        limit = int(self.longest / self.least**2) + 1  # a longer run's words outweigh any template
        best, seen = None, set()
        for x, i in enumerate(hits):
            for j in hits[x:]:
                run = [w for p in parts[i : j + 1] for w in p]
                if j > i and len(run) > limit:
                    break
                key = tuple(run)
                if key not in seen:
                    if len(seen) > 10_000:
                        seen.clear()
                    seen.add(key)
                    got = self.match(run)
                    if got and (best is None or got > best):
                        best = got
        best = self._windows([w for p in parts for w in p], best)
        return None if best is None else (self.names[-best[1]], best[0])


def _frequencies(files: DataFrame, vocabulary: set[bytes]) -> tuple[int, dict[bytes, int], np.ndarray]:
    """How many files there are, how many have each word of the templates, and how many have words of each slot."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, count, slots = 0, Counter(), np.zeros(1 << SLOT_BITS, np.int64)
        crc, shift = zlib.crc32, 32 - SLOT_BITS
        for batch in batches:
            for _, text in texts(batch.column(0)):
                n += 1
                words = set(words_of(text))
                count.update(vocabulary & words)
                slots[np.fromiter(map(crc, words), np.uint32, len(words)) >> np.uint32(shift)] += 1  # once for each file
        words, used = [b"", *count], np.flatnonzero(slots)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*words, *[None] * len(used)], pa.binary()), pa.array([*[None] * len(words), *used.tolist()], pa.int32()), pa.array([n, *(count[w] for w in words[1:]), *slots[used].tolist()], pa.int64())],
            names=["w", "slot", "n"])

    counted = files.select("text").mapInArrow(task, "w binary, slot int, n long").groupBy("w", "slot").agg(F.sum("n").alias("n")).toArrow()  # of the templates' words and 2^SLOT_BITS slots
    found, slots = {}, np.zeros(1 << SLOT_BITS, np.int64)
    for w, slot, n in zip(*(counted[c].to_pylist() for c in ("w", "slot", "n")), strict=True):
        if slot is None:
            found[bytes(w)] = n
        else:
            slots[slot] = n
    return found.pop(b"", 0), found, slots


def scan_files(files: DataFrame, *, least: float = 0.75, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """file_id, path, license and score (null without a notice) of every row of files(file_id, path, text)."""
    n, frequency, slots = _frequencies(files, {w for _, t in templates for w in words_of(t)})
    shared = files.sparkSession.sparkContext.broadcast(Scanner(templates, n, frequency, least, slots))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.scan(t) or (None, None) for _, t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file_id"), batch.column("path"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["file_id", "path", "license", "score"])

    return files.select(F.col("file_id").cast("long"), "path", "text").mapInArrow(task, "file_id long, path string, license string, score double")


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "[^/]*$", "")


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds origin ('file', 'header', 'inherited', else null) and inherited_from (a directory)."""
    named = scanned.withColumns({"dir": _directory(F.col("path")), "is_file": F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILE)})
    own = named.where("is_file and license is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("best"))
    own = own.select(F.col("dir").alias("above"), F.col("best.license").alias("from_license"), (-F.col("best.s")).alias("from_score"))
    dirs = named.where("dir is not null").select("dir").distinct()
    parts = F.split(F.regexp_replace("dir", "/$", ""), "/")
    # '' and each directory on the way, with its closing slash
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.concat_ws("/", F.slice(parts, 1, k)), F.lit("/"))))
    nearest = (
        dirs.select("dir", F.explode(F.array_distinct(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(ups))).alias("above"))
        .join(own, "above").groupBy("dir").agg(F.max_by(F.struct("above", "from_license", "from_score"), F.length("above")).alias("near"))
    )
    joined = named.join(nearest, "dir", "left")
    mine = F.col("license").isNotNull()
    takes = ~mine & F.col("near").isNotNull()
    return joined.select(
        "file_id", "path", F.coalesce("license", "near.from_license").alias("license"), F.coalesce("score", "near.from_score").alias("score"),
        F.when(mine & F.col("is_file"), "file").when(mine, "header").when(takes, "inherited").alias("origin"),
        F.when(takes, F.col("near.above")).alias("inherited_from"),
    )


def license_of(files: DataFrame, *, least: float = 0.75, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """The licence of every row of files(file_id, path, text)."""
    return inherit(stage(scan_files(files, least=least, templates=templates), "scanned"))
