"""License scans: a generalised suffix automaton of template words, matching statistics, and chains of long matches.

All templates are put into one suffix automaton over their words. A text streams through it once: after each word the automaton is in the
state of the longest run of words, ending here, that occurs in some template (the matching statistic). Where such a run ends and has at
least ``shortest`` words it is a match, at the places in the templates that its state knows. Matches that follow each other both in the
text and in a template, with small gaps, are chained; a chain that covers enough of its template is a span with the template's label.
A chain that ended more than a gap ago is closed, so the work grows with the text and not with its square. Where spans overlap, the one
that covers more of its template and then more words stays.

The templates at hand are notices and passages of the common licences. Whole licence texts can be added from a folder
(:func:`folder_templates`), one file a licence.

Words are runs of digits, lower-cased A-Z and non-ASCII characters. Only words that occur in templates can extend a match, so all others
reset the automaton at no cost.

Edge cases: a null text is an empty one, without words. A word can be as long as the text. Rows that repeat are scanned alike. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Labels and passages of public licence texts and notices.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd", "Licensed under the BSD 3-Clause License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "Licensed under CC0 1.0 Universal"),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"),
    ("apache", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("gpl", "The GNU General Public License is a free, copyleft license for software and other kinds of works"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required"),
    ("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
]
#: For each byte the one that words are made of, or a blank.
_WORD_BYTE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_WORD_BYTE).split()


def folder_templates(folder: str) -> list[tuple[str, str]]:
    """(label, text) of every file of a folder of licence texts, such as a distribution's; the label is the file's name, lower-cased."""
    return [(p.name.lower(), p.read_text(encoding="utf-8", errors="replace")) for p in sorted(Path(folder).iterdir()) if p.is_file() and not p.is_symlink()]


class Automaton:
    """Generalised suffix automaton over word lists; ``places`` gives the (template, end) pairs of a state, of those whose longest run has
    at least ``shortest`` words."""

    def __init__(self, templates: list[list[bytes]], shortest: int = 1):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [set()]
        for t, words in enumerate(templates):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self.places[last].add((t, i + 1))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[s] > 0 and self.length[self.link[s]] >= shortest:
                self.places[self.link[s]] |= self.places[s]

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.places.append(set())
        return len(self.next) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        clone = self._new(self.length[p] + 1)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:  # an earlier template has these words already
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._new(self.length[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def matches(self, words: list[bytes], at: list[int], shortest: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of maximal matches; ``at`` lists the places of words that occur in templates."""
        following, link, length = self.next, self.link, self.length
        state = run = 0
        before = -2
        for i in at:
            w = words[i]
            if i != before + 1:
                if run >= shortest:
                    yield before + 1, run, state
                state = run = 0
            elif w not in following[state]:
                if run >= shortest:
                    yield i, run, state
                while state and w not in following[state]:
                    state = link[state]
                    run = length[state]
            state, run, before = following[state][w], run + 1, i
        if run >= shortest:
            yield before + 1, run, state


@dataclass(frozen=True)
class Span:
    label: str
    start: int
    end: int
    coverage: float


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, shortest: int = 3, gap: int = 8, enough: float = 0.8):
        self.labels = [label for label, _ in templates]
        self.words = [words_of(text) for _, text in templates]
        self.automaton = Automaton(self.words, shortest)
        self.phrases: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for phrase, label in phrases.items():
            parts = words_of(phrase)
            self.phrases.setdefault(parts[-1], []).append((parts, label))
        self.known = set(self.automaton.next[0])
        self.last = set(self.phrases)
        self.shortest, self.gap, self.enough = shortest, gap, enough

    def base(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(start, label) of each place where a phrase's words stand consecutively."""
        out = []
        for i in (i for i, w in enumerate(words) if w in self.last) if not self.last.isdisjoint(words) else ():
            for parts, label in self.phrases[words[i]]:
                start = i - len(parts) + 1
                if start >= 0 and words[start : i + 1] == parts:
                    out.append((start, label))
        return out

    def spans(self, words: list[bytes]) -> list[Span]:
        known = self.known
        at = [i for i, w in enumerate(words) if w in known]
        chains: dict[int, list[list[int]]] = {}  # by template, those not closed: [text start, text end, template end, words matched]
        found: list[Span] = []

        def close(t: int, some: list[list[int]]) -> None:
            for start, end, _, matched in some:
                coverage = matched / max(len(self.words[t]), end - start)
                if coverage >= self.enough:
                    found.append(Span(self.labels[t], start, end, coverage))

        for end, run, state in self.automaton.matches(words, at, self.shortest):
            for t, place in self.automaton.places[state]:
                start, begin = end - run, place - run
                active = chains.get(t, [])
                if active and active[0][1] < start - self.gap:
                    close(t, [c for c in active if c[1] < start - self.gap])
                    chains[t] = active = [c for c in active if c[1] >= start - self.gap]
                fits = [c for c in active if c[1] <= start and 0 <= begin - c[2] <= self.gap]
                if fits:
                    c = max(fits, key=lambda c: c[3])
                    c[1], c[2], c[3] = end, place, c[3] + run
                    active.sort(key=lambda c: c[1])
                else:
                    chains.setdefault(t, []).append([start, end, place, run])
        for t, some in chains.items():
            close(t, some)
        starts: list[int] = []
        chosen: dict[int, Span] = {}
        for s in sorted(found, key=lambda s: (-s.coverage, s.start - s.end, s.start, s.label)):
            i = bisect_left(starts, s.end)
            if not i or chosen[starts[i - 1]].end <= s.start:
                starts.insert(i, s.start)
                chosen[s.start] = s
        return [chosen[k] for k in starts]


_SCHEMA = "doc_id long, n_words long, base array<struct<start: long, label: string>>, spans array<struct<label: string, start: long, end: long, coverage: double>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """One row a document: its number of words, the places of phrases and the covered template spans, in words from 0."""
    bounded_batches(docs.sparkSession)
    base = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    spans = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            counts, places, covered = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                counts.append(len(words))
                places.append([{"start": s, "label": x} for s, x in scanner.base(words)])
                covered.append([vars(s) for s in scanner.spans(words)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(places, base), pa.array(covered, spans)],
                ["doc_id", "n_words", "base", "spans"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, _SCHEMA)
