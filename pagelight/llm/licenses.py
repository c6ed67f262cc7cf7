"""Licence scans with a generalised suffix automaton over licence words.

The templates below (base phrases and well-known notices) are cut into words, and one suffix
automaton is built over all of them. A text is streamed through it word by word, which gives the
matching statistics: the longest run of words ending there that occurs in some template. Base
phrases are read from the states, and so, along the suffix links, are the longest runs of every
template at each of its places. These are then chained, per template, in order of both the text
and the template. Chains that cover enough of their template give labels; of those that share
words of the text, the one most like its template counts.

Words are those of `words.alnum_class()`: A-Z lower-cased, runs of [0-9a-z] and non-ASCII.
"""

from __future__ import annotations

import bisect
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import buffers, slices
from .words import alnum_class, hashed_words, word_hash

#: Phrase -> label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices of public licences, as their stewards word them.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed under the Apache License, Version 2.0",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "This work is licensed under the GNU General Public License, version 3",
    ],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}

MIN_MATCH = 3  # words of a match that may enter a chain
MIN_COVER = 0.8  # share of a template's words that its chain covers, for its label
MAX_GAP = 12  # words between matches of a chain, on either side


def split(text: str) -> list[str]:
    """Words of a template (ASCII)."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


class Automaton:
    """A generalised suffix automaton: states by longest string, suffix links and transitions.

    ends[s]: for each template in which a string of state s ends, the places where it does."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, own = [-1], [0], [[]]
        for k, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word, own)
                own[last].append((k, place))
        order = sorted(range(len(self.next)), key=lambda s: -self.size[s])
        self.ends = [sorted(x) for x in own]
        for s in order:
            if self.link[s] > 0:
                self.ends[self.link[s]] = sorted({*self.ends[self.link[s]], *self.ends[s]})

    def _state(self, size: int, link: int, moves: dict, own: list) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.size.append(size)
        own.append([])
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int, own: list) -> int:
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]), own)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int, own: list) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.size[q] == self.size[last] + 1 else self._split(last, word, q, own)
        new = self._state(self.size[last] + 1, 0, {}, own)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q, own)
        return new


class Scanner:
    """The automaton over `base` phrases and `templates`, and what a scan reads off its states."""

    def __init__(self, base: dict[str, str], templates: dict[str, list[str]]):
        phrases = [(label, split(p), True) for p, label in base.items()] + [(label, split(t), False) for label, all_ in templates.items() for t in all_]
        words = sorted({w for _, p, _ in phrases for w in p})
        number = {w: i + 1 for i, w in enumerate(words)}
        hashes = np.array([word_hash(w) for w in words], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], (order + 1).astype(np.int32)
        self.sequences = [[number[w] for w in p] for _, p, _ in phrases]
        self.labels = [label for label, _, _ in phrases]
        self.is_base = [b for _, _, b in phrases]
        self.automaton = Automaton(self.sequences)
        a = self.automaton
        at = []  # the state of each base phrase
        for sequence, b in zip(self.sequences, self.is_base):
            s = 0
            for w in sequence if b else ():
                s = a.next[s][w]
            at.append(s if b else -1)
        whole = {s: k for k, s in enumerate(at) if s >= 0}
        #: For each state the base phrases that are suffixes of its strings, with their lengths.
        self.base_at: list[tuple] = [()] * len(a.next)
        for s in sorted(range(1, len(a.next)), key=lambda s: a.size[s]):
            up = self.base_at[a.link[s]] if a.link[s] >= 0 else ()
            self.base_at[s] = (*up, (whole[s], len(self.sequences[whole[s]]))) if s in whole else up
        #: For each state the templates' places where a suffix of its strings ends, with the next word there (0 at
        #: the end) and the length of the longest such suffix.
        self.runs_at: list[tuple] = [()] * len(a.next)
        for s in sorted(range(1, len(a.next)), key=lambda s: a.size[s]):
            if a.size[s] >= MIN_MATCH:
                own = [(k, p) for k, p in a.ends[s] if not self.is_base[k]]
                self.runs_at[s] = (*((k, p, [*self.sequences[k], 0][p + 1], a.size[s]) for k, p in own), *(x for x in self.runs_at[a.link[s]] if x[:2] not in own))

    def numbers_of(self, h: np.ndarray) -> np.ndarray:
        """Template word numbers of word hashes; 0 for words in no template."""
        i = np.searchsorted(self.hashes, h)
        i[i == len(self.hashes)] = 0
        return np.where(self.hashes[i] == h, self.numbers[i], 0)

    def scan(self, numbers: list[int], start: int, runs: list | None = None):
        """Matching statistics of a run of template words that begins at word `start` of its text:
        base occurrences (label, first word) and right-maximal matches (end, length, state). To `runs` it adds
        each template's own: (end, place in the template, length, template), as far as both go on alike."""
        a = self.automaton
        moves, link, size, base_at, runs_at = a.next, a.link, a.size, self.base_at, self.runs_at
        found, matches = [], []
        state = length = 0
        for i, word in enumerate(numbers):
            if word not in moves[state]:
                if length >= MIN_MATCH:
                    matches.append((start + i - 1, length, state))
                while state and word not in moves[state]:
                    state = link[state]
                    length = size[state]
                if word not in moves[state]:
                    continue
            state = moves[state][word]
            length += 1
            for k, n in base_at[state]:
                if n <= length:
                    found.append((self.labels[k], start + i - n + 1))
            if runs is not None and length >= MIN_MATCH:
                after = numbers[i + 1] if i + 1 < len(numbers) else -1
                for k, place, word, n in runs_at[state]:
                    if word != after:
                        runs.append((start + i, place, min(n, length), k))
        if length >= MIN_MATCH:
            matches.append((start + len(numbers) - 1, length, state))
        return found, matches

    @staticmethod
    def chain(own: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """For each of a template's runs (end, place, length), in order, the best chain that ends with it:
        (words covered, first word, last word); of equal ones the shortest."""
        best: list[tuple[int, int, int]] = []
        for j, (end, place, length) in enumerate(own):
            top = (length, end - length + 1)
            for i in range(j - 1, -1, -1):
                e, p, _ = own[i]
                if end - length - e > MAX_GAP:
                    break
                new = min(length, end - e, place - p)
                if e < end and p < place and place - length - p <= MAX_GAP and new > 0:
                    top = max(top, (best[i][0] + new, best[i][1]))
            best.append((*top, end))
        return best

    def chains(self, runs: list[tuple[int, int, int, int]]):
        """(spans, score): all spans (label, first word, last word, share covered) that cover enough of a template and
        share no word, and the largest share that any chain covers. Of a label's chains those of more words come
        first; of several labels' those most like their template, both in words covered and in words between.
        Words of the spans found are then taken out, and what remains is chained again."""
        out: list[tuple[str, int, int, float]] = []
        score = 0.0
        by: dict[int, list] = {}
        for end, place, length, k in sorted(runs):
            by.setdefault(k, []).append((end, place, length))
        while by:
            of: dict[str, list] = {}
            for k, own in by.items():
                n = len(self.sequences[k])
                for covered, first, last in self.chain(own):
                    score = max(score, covered / n)
                    if covered >= MIN_COVER * n:
                        of.setdefault(self.labels[k], []).append((covered, 2 * covered / (n + last - first + 1), first, last, covered / n))
            some = []
            for label, all_ in of.items():
                taken = Spans()
                some += [(like, covered, label, first, last, share) for covered, like, first, last, share in sorted(all_, key=lambda x: (-x[0], -x[1], x[2])) if taken.add(first, last)]
            taken = Spans()
            out += [(label, first, last, share) for _, _, label, first, last, share in sorted(some, key=lambda x: (-x[0], -x[1], x[3], x[2])) if taken.add(first, last)]
            if not some:
                break
            by = {k: free for k, own in by.items() if (free := sorted(x for run in own for x in taken.free(*run)))}
        return sorted(out, key=lambda x: (x[1], x[2], x[0])), min(1.0, score)


class Spans:
    """Spans of words that share none, in order."""

    def __init__(self):
        self.first: list[int] = []
        self.last: list[int] = []

    def add(self, first: int, last: int) -> bool:
        """Takes a span in unless it shares a word with one."""
        i = bisect.bisect_left(self.last, first)
        if i < len(self.last) and self.first[i] <= last:
            return False
        self.first.insert(i, first)
        self.last.insert(i, last)
        return True

    def free(self, end: int, place: int, length: int):
        """The parts of a run outside of all spans that are long enough to enter a chain."""
        start, i = end - length + 1, bisect.bisect_left(self.last, end - length + 1)
        while start <= end:
            stop = min(end, self.first[i] - 1) if i < len(self.first) else end
            if stop - start + 1 >= MIN_MATCH:
                yield stop, place - (end - stop), stop - start + 1
            if i == len(self.first):
                return
            start, i = self.last[i] + 1, i + 1


@functools.lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(BASE, TEMPLATES)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,covered:double>>"
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.float64())]))
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licence evidence of every text, one row a row of `docs` (ids may be null or repeat).

    n_base, first_word, last_word, base_labels: places of the base phrases; labels: theirs and those
    of covered templates; spans: all covered template spans, which share no word; score: the largest share of a template
    or a base phrase that is covered. A null or empty text has no words, no labels and score 0.
    """

    def run(batches):
        s, inside = scanner(), alnum_class()
        for batch in batches:
            raw, off = buffers(batch.column(1))
            for lo, hi in slices(off, 1_000_000):
                h, first = hashed_words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], inside)
                numbers = s.numbers_of(h)
                known = numbers > 0
                known_at = known.copy()
                known_at[1:] &= ~known[:-1]
                edge = first[:-1][first[:-1] < len(h)]
                known_at[edge] = known[edge]
                opens = np.flatnonzero(known_at)
                stop = known.copy()
                stop[:-1] &= ~known[1:]
                ends = edge[edge > 0] - 1
                stop[ends] |= known[ends]
                closes = np.flatnonzero(stop) + 1
                wide = closes - opens >= 2  # no phrase has one word
                opens, closes = opens[wide], closes[wide]
                doc = np.searchsorted(first, opens, side="right") - 1
                found: dict[int, tuple[list, list]] = {}
                for d, a, b in zip(doc.tolist(), opens.tolist(), closes.tolist()):
                    runs: list = []
                    base, _ = s.scan(numbers[a:b].tolist(), a - int(first[d]), runs)
                    if base or runs:
                        x = found.setdefault(d, ([], []))
                        x[0].extend(base)
                        x[1].extend(runs)
                rows = []
                for d, (doc_id, n) in enumerate(zip(batch.column(0).slice(lo, hi - lo).to_pylist(), np.diff(first).tolist())):
                    base, runs = found.get(d, ((), ()))
                    spans, score = s.chains(runs)
                    own = sorted({x for x, _ in base})
                    places = [p for _, p in base]
                    score = 1.0 if base else score
                    rows.append((doc_id, n, len(base), min(places, default=None), max(places, default=None), ",".join(own), ",".join(sorted({*own, *(x[0] for x in spans)})), score, [dict(zip(("label", "first_word", "last_word", "covered"), x)) for x in spans]))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=[f.split(" ")[0] for f in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
