"""Licence scans with a generalised suffix automaton over the words of licence templates.

The automaton holds all runs of words of all templates. A text streams through it word by word, which gives at every word the longest run that ends there and stands in a template (matching statistics). Where that run cannot grow, it is a maximal match; matches of at least MIN_MATCH words are placed in the templates that hold them and chained, in order in both text and template with small gaps, into spans. A template is found where a chain covers enough of it. Phrases are found at every place where the current run ends with one.

Words are runs of bytes that are letters of a-z (after lower-casing A-Z), digits or parts of characters beyond ASCII.
Edge cases: null counts as empty; texts without words have no places; overlapping places of phrases all count; memory is bounded by one text and the automaton; equal rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MIN_MATCH = 3
MAX_GAP = 12
#: Share of a template's words that a chain covers, at least; templates of over LONG_WORDS words are found by LONG_COVER words too.
MIN_COVER = 0.75
LONG_WORDS, LONG_COVER = 40, 24

#: Phrases whose every place counts, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Wordings by which common licences are granted, with their labels.
TEMPLATES: list[tuple[str, str]] = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("reserved", "Copyright. All rights reserved."),
]


def words_of(text: str) -> list[bytes]:
    # bytes.lower() changes A-Z alone.
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


@dataclass
class Span:
    label: str
    start: int
    end: int
    cover: float


@dataclass
class SuffixAutomaton:
    templates: list[tuple[str, str]] = field(default_factory=lambda: TEMPLATES)
    phrases: dict[str, str] = field(default_factory=lambda: PHRASES)

    def __post_init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[list[tuple[int, int]]] = [[]]  # (template, position of the last word) of a state's own ends
        self.sizes: list[int] = []
        for t, (_, text) in enumerate(self.templates):
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            self.sizes.append(len(words))
            self._add(words, t)
        starts = []
        for phrase in self.phrases:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(phrase)]
            self._add(words, None)
            starts.append(words)
        # Ends of a state are those of all states whose suffix link leads to it.
        children: list[list[int]] = [[] for _ in self.next]
        for s in range(1, len(self.next)):
            children[self.link[s]].append(s)
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in order:
            if self.link[s] > 0:
                self.places[self.link[s]].extend(self.places[s])
        self.ends = [sorted(set(p)) for p in self.places]
        # Phrases that end each state's runs, with their number of words.
        self.phrase_at: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for words, (_, label) in zip(starts, self.phrases.items(), strict=True):
            s = 0
            for w in words:
                s = self.next[s][w]
            todo = [s]
            while todo:
                x = todo.pop()
                self.phrase_at[x].append((len(words), label))
                todo += children[x]

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.places.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _add(self, words: list[int], template: int | None) -> None:
        last = 0
        for i, w in enumerate(words):
            if w in self.next[last]:
                q = self.next[last][w]
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
            else:
                new = self._new(self.length[last] + 1, 0, {})
                p = last
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][w]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
                last = new
            if template is not None:
                self.places[last].append((template, i))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[Span]]:
        """Places (start, label) of the phrases, and the spans of the templates."""
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int32, count=len(words))
        known = np.flatnonzero(ids)
        places: list[tuple[int, str]] = []
        matches: list[tuple[int, int, int]] = []  # start, end, state
        state, n, before = 0, 0, -2
        stream = known[np.concatenate((known[1:] - known[:-1] == 1, [False])) | np.concatenate(([False], known[1:] - known[:-1] == 1))] if len(known) > 1 else known
        for at in stream.tolist():
            if at != before + 1:
                if n >= MIN_MATCH:
                    matches.append((before - n + 1, before + 1, state))
                state, n = 0, 0
            w = int(ids[at])
            moved = self.next[state].get(w)
            if moved is None:
                if n >= MIN_MATCH:
                    matches.append((at - n, at, state))
                while state > 0 and w not in self.next[state]:
                    state = self.link[state]
                    n = self.length[state]
                moved = self.next[state].get(w)
                if moved is None:
                    state, n, before = 0, 0, at
                    continue
            state, n, before = moved, n + 1, at
            for size, label in self.phrase_at[state]:
                if n >= size:
                    places.append((at - size + 1, label))
        if n >= MIN_MATCH:
            matches.append((before - n + 1, before + 1, state))
        return places, self._chains(matches)

    def _chains(self, matches: list[tuple[int, int, int]]) -> list[Span]:
        """Chains of matches, in order in text and template. A match that overlaps the chain before it, in either, is trimmed at its start; the best chain that ends with each match is kept open until the text has gone MAX_GAP words on. Of chains that overlap in the text, the one that covers most of its template is reported."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for a, z, s in matches:
            for t, end in self.ends[s]:
                by_template.setdefault(t, []).append((a, z, end - (z - a) + 1))
        out = []
        for t, found in by_template.items():
            size = self.sizes[t]
            least = min(MIN_COVER * size, LONG_COVER) if size > LONG_WORDS else MIN_COVER * size
            open_: list[tuple[int, int, int, int]] = []  # start, end, template end, covered
            enough: list[tuple[int, int, int]] = []
            for a, z, ta in sorted(found):
                open_ = [c for c in open_ if a - c[1] <= MAX_GAP]
                start, covered = a, z - a
                for c in open_:
                    trim = max(0, c[1] - a, c[2] - ta)
                    if trim < z - a and a + trim - c[1] <= MAX_GAP and ta + trim - c[2] <= MAX_GAP and (c[3] + z - a - trim, -c[0]) > (covered, -start):
                        start, covered = c[0], c[3] + z - a - trim
                open_.append((start, z, ta + z - a, covered))
                if covered >= least:
                    enough.append((covered, start, z))
            taken: list[tuple[int, int]] = []
            for covered, a, z in sorted(enough, key=lambda c: (-c[0], c[1], c[2])):
                at = bisect.bisect(taken, (a, z))
                if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or z <= taken[at][0]):
                    taken.insert(at, (a, z))
                    out.append(Span(self.templates[t][0], a, z, covered / size))
        return sorted(out, key=lambda s: (s.start, s.end, s.label))


_AUTOMATA: list[SuffixAutomaton] = []


def _automaton() -> SuffixAutomaton:
    if not _AUTOMATA:
        _AUTOMATA.append(SuffixAutomaton())
    return _AUTOMATA[0]


SCHEMA = "doc_id long, n_words long, places array<struct<start:long,label:string>>, spans array<struct<label:string,start:long,end:long,cover:double>>"
_PLACE = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document: the places of the phrases and the spans of the templates, in words from 0. A map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton()
        for b in batches:
            n, places, spans = [], [], []
            for t in b.column(1).to_pylist():
                words = words_of(t or "")
                found, chained = a.scan(words)
                n.append(len(words))
                places.append([{"start": s, "label": x} for s, x in found])
                spans.append([vars(s) for s in chained])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(places, _PLACE), pa.array(spans, _SPAN)], ["doc_id", "n_words", "places", "spans"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, SCHEMA)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, first and last place, labels and score (the largest share of a template that is covered; 1 where a phrase is found)."""
    return scanned.selectExpr(
        "doc_id",
        "n_words",
        "cast(size(places) as long) as n_base",
        "array_min(places.start) as first_word",
        "array_max(places.start) as last_word",
        "array_join(array_sort(array_distinct(places.label)), ',') as base_labels",
        "array_join(array_sort(array_distinct(concat(places.label, spans.label))), ',') as labels",
        "cast(case when size(places) > 0 then 1.0 else least(1.0, coalesce(array_max(spans.cover), 0.0)) end as double) as score",
    )
