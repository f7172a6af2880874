"""License notices in documents: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are cut to words. Of each window of words the one that is rarest in the templates is kept (winnowing) and put
into an inverted index from word to templates. A notice at the coverage holds, at worst, runs of so many template words
as its window has, so one kept word is in it whatever was changed, left out or put in between; fingerprints of several
words would be broken by words put in. Where enough kept words and a stretch with enough of a template's words are
found, a local alignment of words within the band of the kept words' diagonals gives the best notice; the rest of the
stretch is aligned again until nothing reaches the coverage.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from loomgraph.llm.common import of_texts

BAND, COVERAGE = 8, 0.75
#: The index goes to each task whole: templates may have so many words in all.
MAX_TEMPLATE_WORDS = 2_000_000

# Fixed texts: short notices of common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-notice": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-notice": "Licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_WORD = re.compile(r"[^\W_]+")
_MATCH, _MISS, _GAP = 2, -1, -1
_SCHEMA = "license string, coverage double, matched long, template_words long, start long, stop long"


def winnowed(ranks: list, window: int) -> list[int]:
    """Positions of the last least rank of each window."""
    kept: list[int] = []
    for i in range(max(1, len(ranks) - window + 1)) if ranks else ():
        at = min(range(i, min(i + window, len(ranks))), key=lambda j: (ranks[j], -j))
        if not kept or kept[-1] != at:
            kept.append(at)
    return kept


class Index:
    """Inverted index of the templates' fingerprints. A template without words is never found."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        words = {n: _WORD.findall(templates[n].lower()) for n in sorted(templates)}
        self.names = [n for n in words if words[n]]
        self.words = [words[n] for n in self.names]
        if sum(map(len, self.words)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates have more than {MAX_TEMPLATE_WORDS} words")
        uses = Counter(w for words in self.words for w in words)
        self.numbers = [{w: i for i, w in enumerate(dict.fromkeys(words))} for words in self.words]
        self.places: list[dict[str, list[int]]] = []  # by template: the kept words and where they stand
        self.least: list[int] = []  # words that a notice has
        self.needed: list[int] = []  # kept places whose words it has
        self.kept: dict[str, list[tuple[int, int]]] = defaultdict(list)  # by word: template, times kept
        for t, words in enumerate(self.words):
            least = max(1, math.ceil(coverage * len(words) - 1e-9))
            missing = len(words) - least
            kept = winnowed([(uses[w], xxhash.xxh3_64_intdigest(w)) for w in words], -(-least // (missing + 1)))
            places: dict[str, list[int]] = defaultdict(list)
            for at in kept:
                places[words[at]].append(at)
            self.places.append(dict(places))
            self.least.append(least)
            self.needed.append(max(1, len(kept) - missing))
            for w, at in places.items():
                self.kept[w].append((t, len(at)))

    def candidates(self, words: list[str], band: int) -> Iterator[tuple[int, int, int, int, int]]:
        """Template, first and last document word and first and last diagonal (document less template position) of each stretch that may hold notices."""
        found: Counter[int] = Counter()
        for w in self.kept.keys() & set(words):
            for t, n in self.kept[w]:
                found[t] += n
        for t in sorted(t for t, n in found.items() if n >= self.needed[t]):
            numbers, places = self.numbers[t], self.places[t]
            inside = np.flatnonzero(np.fromiter((w in numbers for w in words), bool, len(words)))
            least, length = self.least[t], len(self.words[t]) + 2 * band
            if len(inside) < least:
                continue
            starts = inside[: len(inside) - least + 1]
            starts = starts[inside[least - 1 :] - starts < length]
            for group in np.split(starts, np.flatnonzero(np.diff(starts) >= length) + 1) if len(starts) else ():
                first, stop = int(group[0]), min(len(words), int(group[-1]) + length)
                diagonals = [at - place for at in range(first, stop) for place in places.get(words[at], ())]
                if diagonals:
                    yield t, first, stop, min(diagonals) - band, max(diagonals) + band


def align(template: np.ndarray, words: np.ndarray, low: int, high: int, least: int) -> list[tuple[int, int, int]]:
    """The best local alignments within diagonals low to high that match `least` words or more: matched words and span of document words.

    They have the same score and don't overlap. Cells are arrays over the diagonals.
    """
    size, n = len(template), len(words)
    low, high = max(low, 1 - size), min(high, n - 1)
    if low > high:
        return []
    far = -4 * (size + n)
    padded = np.full(n + 2 * size, -2)
    padded[size : size + n] = words
    steps = np.arange(high - low + 1)
    score, matched, first = np.full(len(steps) + 1, far), np.zeros(len(steps) + 1, np.int64), np.zeros(len(steps) + 1, np.int64)
    best, best_matched, best_first = (np.zeros(n + 2 * size, np.int64) for _ in range(3))
    for i, word in enumerate(template):
        j = low + i + steps
        ends = slice(size + low + i, size + high + i + 1)
        row = padded[ends]
        same = row == word
        fresh = score[:-1] <= 0
        cell = np.where(fresh, 0, score[:-1]) + np.where(same, _MATCH, _MISS)
        cell_matched, cell_first = np.where(fresh, 0, matched[:-1]) + same, np.where(fresh, j, first[:-1])
        up = score[1:] + _GAP
        over = up > cell
        cell, cell_matched, cell_first = np.where(over, up, cell), np.where(over, matched[1:], cell_matched), np.where(over, first[1:], cell_first)
        cell[row == -2] = far
        # a gap in the template costs the same for each word, so the best cell to the left is that of a running maximum
        level = cell - _GAP * steps
        top = np.maximum.accumulate(level)
        origin = np.maximum.accumulate(np.where(level == top, steps, 0))
        cell, cell_matched, cell_first = top + _GAP * steps, cell_matched[origin], cell_first[origin]
        cell[row == -2] = far
        score[:-1], matched[:-1], first[:-1] = cell, cell_matched, cell_first
        if i + 1 >= least:
            better = (cell > best[ends]) & (cell_matched >= least)
            best[ends][better], best_matched[ends][better], best_first[ends][better] = cell[better], cell_matched[better], cell_first[better]
    out: list[tuple[int, int, int]] = []
    for at in np.flatnonzero(best == best.max()) if best.any() else ():
        start, stop = int(best_first[at]), int(at) - size + 1
        if not out or start >= out[-1][2]:
            out.append((int(best_matched[at]), start, stop))
    return out


def notices(template: np.ndarray, words: np.ndarray, low: int, high: int, least: int) -> list[tuple[int, int, int]]:
    """All notices of a template in a stretch: the best alignments, then the best of what is left between them."""
    out, todo = [], [(0, len(words))]
    while todo:
        start, stop = todo.pop()
        if np.count_nonzero(words[start:stop] >= 0) < least:
            continue
        found = [(m, start + a, start + b) for m, a, b in align(template, words[start:stop], low - start, high - start, least)]
        if found:
            out += found
            todo += zip([start, *(f[2] for f in found)], [*(f[1] for f in found), stop], strict=True)
    return out


def matches(text: str | None, index: Index, band: int = BAND) -> list[tuple]:
    """The notices of a text: name, coverage, matched words, template's words, span of characters. Of notices that overlap, the one with more matched words stays."""
    if not text:
        return []
    words = list(map(str.lower, _WORD.findall(text)))
    out: set[tuple] = set()
    found: list = []
    for t, first, stop, low, high in index.candidates(words, band):
        found = found or list(_WORD.finditer(text))
        numbers, size = index.numbers[t], len(index.words[t])
        template = np.array([numbers[w] for w in index.words[t]])
        stretch = np.array([numbers.get(w, -1) for w in words[first:stop]])
        for matched, start, end in notices(template, stretch, low - first, high - first, index.least[t]):
            out.add((index.names[t], matched / size, matched, size, found[first + start].start(), found[first + end - 1].end()))
    starts: list[int] = []
    kept: list[tuple] = []
    for m in sorted(out, key=lambda m: (-m[2], -m[1], m[4], m[0])):
        at = bisect_left(starts, m[4])
        if (at == 0 or kept[at - 1][5] <= m[4]) and (at == len(kept) or m[5] <= kept[at][4]):
            starts.insert(at, m[4])
            kept.insert(at, m)
    return kept


def scan(docs: DataFrame, templates: dict[str, str] | None = None, band: int = BAND, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, matched, template_words, start and stop of each notice in docs (doc_id, text).

    Whole texts are read. A text without notices, null or empty, gives no row; repeated rows give their notices each;
    an empty table gives none. Other columns are left out. Positions count code points.
    """
    index = Index(TEMPLATES if templates is None else templates, coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i in range(batch.num_rows):
                for m in matches(batch.column(1)[i].as_py(), index, band):
                    rows.append(i)
                    found.append(m)
            columns = list(zip(*found, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            made = [batch.column(0).take(pa.array(rows, pa.int32())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.record_batch(made, names=["doc_id", *(x.split()[0] for x in _SCHEMA.split(", "))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return of_texts(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_SCHEMA}")
