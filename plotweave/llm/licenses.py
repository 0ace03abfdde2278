"""Licence scans: a generalised suffix automaton of licence words.

Documents stream through the automaton, which has for each word the longest run ending there that occurs in any template
(matching statistics). Runs that can't be extended and are long enough are chained in template order into spans; a span
that covers enough of a template gives its label. Short phrases are templates too, and found by the same automaton.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import ready, table, text_of

#: Each place of these words gives the label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Openings, conditions and disclaimers of public licences, as their own texts have them.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("apache", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
)

#: Bytes to bytes: A-Z to a-z, what no word has to a space.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

LEAST_RUN, MOST_GAP, LEAST_COVER = 4, 40, 0.5


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ")


class Automaton:
    """Generalised suffix automaton of word sequences. States are numbers; the root is 0."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (sequence, words before the end)
        for s, sequence in enumerate(sequences):
            last = 0
            for i, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((s, i + 1))
        self.whole: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)  # (sequence, its length) that end every run of the state
        for state in sorted(range(len(self.next)), key=self.length.__getitem__, reverse=True):
            if state:
                self.ends[self.link[state]] |= self.ends[state]
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = tuple((s, end) for s, end in self.ends[state] if end == len(sequences[s]) == self.length[state])
            self.whole[state] = self.whole[self.link[state]] + own

    def _state(self, length: int, after: dict[int, int], link: int) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, word: int) -> int:
        """The state of p's longest run and this word; it may have to be split off."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        self.link[new] = self._split(p, word) if p >= 0 else 0
        return new

    def statistics(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """For each word the state and the length of the longest run that ends with it."""
        state = length = 0
        for word in ids:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            yield state, length


class Scanner:
    """Templates and phrases, and what a text has of them."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        texts = [*((label, text) for label, text in templates), *((label, phrase) for phrase, label in phrases.items())]
        self.labels, self.n_templates = [label for label, _ in texts], len(templates)
        sequences = [[w for w in words_of(text) if w] for _, text in texts]
        vocabulary = sorted({w for s in sequences for w in s})
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton([[self.ids[w] for w in s] for s in sequences])

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """(words, phrase places as (first word, label), spans as (label, first word, word after, covered share))."""
        words = [w for w in words_of(text) if w]
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        known = np.concatenate(([0], (ids >= 0).view(np.int8), [0]))
        edges = np.flatnonzero(np.diff(known))
        places: list[tuple[int, str]] = []
        runs: list[tuple[int, int, int, int]] = []  # template, first word, its place in the template, length
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a < 2:
                continue
            before, end = (0, 0), a
            for end, now in enumerate(self.automaton.statistics(ids[a:b].tolist()), a):
                if now[1] <= before[1]:
                    self._run(runs, before, end)
                for s, size in self.automaton.whole[now[0]]:
                    if s >= self.n_templates and size <= now[1]:
                        places.append((end - size + 1, self.labels[s]))
                before = now
            self._run(runs, before, b)
        return len(words), places, self._chain(runs)

    def _run(self, runs: list, found: tuple[int, int], end: int) -> None:
        state, length = found
        if length >= LEAST_RUN:
            runs.extend((s, end - length, e - length, length) for s, e in self.automaton.ends[state] if s < self.n_templates)

    def _chain(self, runs: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Per template, chains of runs that follow one another in both text and template, with gaps of MOST_GAP words at most."""
        spans, runs = [], sorted(runs)
        best: list[tuple[int, int, int]] = []  # covered words, first word, word after, by run
        low = 0
        for i, (s, at, place, length) in enumerate(runs):
            while runs[low][0] != s or runs[low][1] + runs[low][3] + MOST_GAP < at and low < i:
                low += 1
            now = (length, at, at + length)
            for j in range(low, i):
                _, a, p, n = runs[j]
                over = max(0, a + n - at, p + n - place)  # words that both runs have
                if over < length and p < place and a < at and a + n + MOST_GAP >= at and place - p - n <= MOST_GAP and best[j][0] + length - over > now[0]:
                    now = (best[j][0] + length - over, best[j][1], at + length)
            best.append(now)
        for (s, *_), (covered, first, after) in zip(runs, best):
            if covered >= LEAST_COVER * self.sizes[s]:
                spans.append((self.labels[s], first, after, covered / self.sizes[s]))
        top: dict[tuple[str, int], tuple] = {}
        for span in spans:
            key = span[:2]
            if key not in top or span[3] > top[key][3]:
                top[key] = span
        self.most = max((c / self.sizes[s] for (s, *_), (c, *_) in zip(runs, best)), default=0.0)
        return sorted(top.values())


@functools.cache
def scanner() -> Scanner:
    return Scanner()


_SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from plotweave.llm.licenses import scanner

    own = scanner()
    for batch in batches:
        out = []
        for text in batch["text"]:
            n, places, spans = own.scan(text.as_py())
            base, labels = {label for _, label in places}, {x[0] for x in spans}
            starts = [x for x, _ in places]
            out.append((n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), min(1.0, max(own.most, float(bool(places)))), [dict(zip(("label", "start", "end", "covered"), x)) for x in spans]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPAN]
        columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans: one row for each row of docs.

    n_base counts all places of the phrases. labels are those of the phrases and of the spans; score is the largest share
    of a template that a chain of runs covers, 1 where a phrase is found whole.

    Null text counts as empty: no words, null places, empty labels, score 0. Very long texts: whole, one at a time. Repeated
    rows have equal results, each its own; null doc_id stays null. No rows: no rows. Other columns are ignored.
    """
    ready(docs.sparkSession)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,covered:double>>"
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(_scan, schema)


def op7(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
