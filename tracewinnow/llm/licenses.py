"""Licence scans with a generalised suffix automaton of licence words.

The automaton holds every substring of every template, in words.  A text is
streamed through it once; at each word the longest template substring that
ends there is known (matching statistics).  Long matches of one template that
lie in the same order in text and template are chained into a span, and the
part of the template that the chain covers is the span's score.

Only runs of words whose neighbours occur side by side in some template are
streamed: a match of ``MIN_WORDS`` words has no other pair of neighbours.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices, utf8

#: Phrases whose places are always reported, with their labels.  Fixed values.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Disclaimers that several licences share.  Fixed values.
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
MIT_DISCLAIMER = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
ISC_TERMS = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_DISCLAIMER = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
GNU_NO_WARRANTY = "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU"

#: Templates: licences whole where they are short, the notices that the longer ones ask for, and usual one-line statements.  Fixed values.
TEMPLATES = (
    ("mit", MIT_GRANT),
    ("mit", f"{MIT_GRANT} {MIT_DISCLAIMER}"),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, {GNU_NO_WARRANTY} General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("gpl", f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, {GNU_NO_WARRANTY} General Public License for more details."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", f"This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, {GNU_NO_WARRANTY} Lesser General Public License for more details."),
    ("agpl", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, {GNU_NO_WARRANTY} Affero General Public License for more details."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("bsd", BSD_TERMS),
    ("bsd", f"{BSD_TERMS} {BSD_DISCLAIMER}"),
    ("bsd", f"{BSD_TERMS} {BSD_NAMES} {BSD_DISCLAIMER}"),
    ("isc", ISC_TERMS),
    ("isc", f"{ISC_TERMS} {ISC_DISCLAIMER}"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)

#: The least words of a match that enters a chain, the most words between matches of a chain, and the least part of a template that labels a text.
MIN_WORDS, MAX_GAP, MIN_COVER = 4, 12, 0.6

#: Bytes to word bytes: A-Z become a-z; digits, a-z and bytes of other scripts stay; the rest separates.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton over word numbers.

    ``next[s]``: transitions; ``link[s]``: suffix link; ``length[s]``: longest
    substring of the state; ``ends[s]``: template -> ends of its substrings there.
    """

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]
        for t, text in enumerate(texts):
            last = 0
            for i, w in enumerate(text):
                last = self.extend(last, w)
                self.ends[last].setdefault(t, []).append(i)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for s in order:  # a suffix ends wherever the longer substring does
            parent = self.ends[self.link[s]]
            for t, at in self.ends[s].items():
                parent[t] = sorted({*parent.get(t, ()), *at})

    def add(self, length: int, like: int | None = None) -> int:
        self.next.append(dict(self.next[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else 0)
        self.length.append(length)
        self.ends.append({})
        return len(self.length) - 1

    def split(self, p: int, w: int, q: int) -> int:
        """The state of ``p`` extended by ``w``, apart from longer substrings that share its end."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self.add(self.length[p] + 1, like=q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self.split(last, w, self.next[last][w])
        new, p = self.add(self.length[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self.split(p, w, self.next[p][w])
        return new

    def statistics(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """For each word the state and length of the longest substring that ends there."""
        s = n = 0
        for w in ids:
            while s and w not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if w in self.next[s]:
                s, n = self.next[s][w], n + 1
            else:
                s = n = 0
            yield s, n


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES):
        self.labels = [label for label, _ in templates]
        texts = [words(t.encode()) for _, t in templates]
        self.phrases = [(words(p.encode()), label) for p, label in phrases]
        self.vocab: dict[bytes, int] = {}
        for t in [*texts, *(p for p, _ in self.phrases)]:
            for w in t:
                self.vocab.setdefault(w, len(self.vocab))
        coded = [[self.vocab[w] for w in t] for t in texts]
        self.sizes = [len(t) for t in coded]
        self.automaton = Automaton(coded)
        n = len(self.vocab)
        self.pairs = np.zeros((n + 1, n + 1), dtype=bool)  # the last row and column: any other word
        for t in coded:
            self.pairs[t[:-1], t[1:]] = True
        self.coded_phrases = [[self.vocab[w] for w in p] for p, _ in self.phrases]

    def matches(self, ids: list[int], offset: int) -> list[tuple[int, int, int, int]]:
        """Maximal matches of at least ``MIN_WORDS`` of each template by itself: template, first and last word in the text, last word in the template.

        At each word the states on the way up the suffix links give the longest
        match of every template that has one; it is maximal where the next word
        doesn't lengthen it.
        """
        auto, out = self.automaton, []
        before: dict[int, tuple[int, int]] = {}  # template: length of its longest match up to the word before, and the state
        for i, (s, n) in enumerate([*auto.statistics(ids), (0, 0)]):
            now: dict[int, tuple[int, int]] = {}
            while n >= MIN_WORDS:
                for t in auto.ends[s]:
                    now.setdefault(t, (n, s))
                s = auto.link[s]
                n = auto.length[s]
            for t, (m, q) in before.items():
                if now.get(t, (0, 0))[0] != m + 1:
                    out += [(t, offset + i - m, offset + i - 1, e) for e in auto.ends[q][t]]
            before = now
        return out

    def chains(self, found: list[tuple[int, int, int, int]]) -> list[tuple[float, int, int, int]]:
        """Best chain of each template from its matches, in stretches of the text: cover, template, first and last word."""
        out = []
        for t in {m[0] for m in found}:
            own = sorted((b, a, e) for u, a, b, e in found if u == t)
            best: list[tuple[int, int]] = []  # words covered by the best chain that ends here, and where it begins
            for k, (b, a, e) in enumerate(own):
                n, first, top = b - a + 1, a, b - a + 1
                for j in range(bisect_left(own, (a - MAX_GAP - 1,), 0, k), k):
                    bj, aj, ej = own[j]
                    if bj < b and ej < e:
                        fresh = min(n, b - bj, e - ej)
                        if best[j][0] + fresh > top:
                            top, first = best[j][0] + fresh, best[j][1]
                best.append((top, first))
            spans: dict[int, tuple[int, int]] = {}
            for (b, _, _), (top, first) in zip(own, best):
                spans[first] = max(spans.get(first, (0, 0)), (top, b))
            out += [(top / self.sizes[t], t, first, b) for first, (top, b) in spans.items()]
        return out

    def scan(self, texts: list[bytes]) -> list[tuple]:
        """For each text: number of words, base places (start, phrase), spans (label, start, end, score)."""
        other = len(self.vocab)
        get, flat, starts, counts = self.vocab.get, [], [], []
        for text in texts:
            own = words(text)
            starts.append(len(flat))
            counts.append(len(own))
            flat += [get(w, other) for w in own]
            flat.append(other)
        ids = np.array(flat, dtype=np.int32)
        starts_a = np.array(starts, dtype=np.int64)
        base: list[list[tuple[int, int]]] = [[] for _ in texts]
        spans: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
        for k, phrase in enumerate(self.coded_phrases):
            hit = np.ones(max(0, len(ids) - len(phrase) + 1), dtype=bool)
            for j, w in enumerate(phrase):
                hit &= ids[j : len(hit) + j] == w
            at = np.flatnonzero(hit)
            for d, i in zip((np.searchsorted(starts_a, at, "right") - 1).tolist(), at.tolist()):
                base[d].append((i - starts[d], k))
        good = np.concatenate(([False], self.pairs[ids[:-1], ids[1:]], [False])) if len(ids) else np.zeros(2, bool)
        edge = np.flatnonzero(good[1:] != good[:-1])
        begin, end = edge[::2], edge[1::2]  # pairs begin..end-1 hold, so words begin..end do
        long = end - begin >= MIN_WORDS - 1
        found: dict[int, list] = {}
        for b, e in zip(begin[long].tolist(), end[long].tolist()):
            d = int(np.searchsorted(starts_a, b, "right")) - 1
            found.setdefault(d, []).extend(self.matches(flat[b : e + 1], b - starts[d]))
        for d, own in found.items():
            best: dict[tuple[str, int], tuple] = {}
            for score, t, first, last in self.chains(own):
                key = (self.labels[t], last)
                best[key] = max(best.get(key, (0.0,)), (score, first))
            spans[d] = sorted((label, first, last + 1, min(1.0, score)) for (label, last), (score, first) in best.items() if score >= MIN_COVER)
        return list(zip(counts, base, spans))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,score:double>>"
SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts, labels and covered template spans, in words from 0.

    ``score`` is the largest part of a template that a span covers; a text with
    a base phrase scores at least ``MIN_COVER``.  A null text counts as empty:
    no words, no labels, score 0.  Texts are scanned whole, however long.  Of
    chains that cover as much and end at the same word the one that begins last
    stays.  Repeated rows give repeated results, rows without an id keep a null
    id, an empty table gives an empty result, and other columns are ignored,
    whatever their names.
    """

    def run(batches):
        scanner = Scanner()
        for batch in slices(batches):
            rows = []
            for n, base, spans in scanner.scan(utf8(batch.column("text"))):
                at = [i for i, _ in base]
                base_labels = {scanner.phrases[k][1] for _, k in base}
                score = max([s for *_, s in spans], default=0.0)
                rows.append((n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {s[0] for s in spans})), max(score, MIN_COVER) if base else score, [{"label": a, "start": b, "end": c, "score": d} for a, b, c, d in spans]))
            cols = list(zip(*rows))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), SPAN]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(map_batches, run, SCHEMA)
