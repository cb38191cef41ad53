"""Licence scan: winnowed fingerprints of templates pick candidates, banded alignment confirms them.

The band follows the longest chain of runs of GRAM words that a template and the text around a candidate share, and is as wide
as the chain leaps, so lines that were put in, taken out or edited don't end an alignment, in notices and whole licences alike.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.decontaminate import words_of

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
GRAM, WINDOW, COVERAGE = 3, 3, 0.8
#: Words on each side of the chain that an alignment may leave it by.
BAND = 16
#: Templates of up to so many words are notices: a span must hold all their numbers, which tell versions apart. Of others the chain must
#: hold this share of the words.
NOTICE, CHAINED = 100, 0.4
# Words that turn the name of one licence into that of another.
MARKS = ("affero", "lesser", "library", "noncommercial", "sharealike", "noderivatives", "noderivs", "nc", "sa", "nd")

MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
BSD_FIRST = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_SECOND = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'


def gnu_notice(what: str, licence: str, version: str) -> str:
    return f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {licence} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


#: The adjectives that a Creative Commons licence's letters stand for.
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
      "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

# Notices and licence texts as their public sources give them. Parts of a text are templates of
# their own, for texts that hold no more than the part.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", MIT_GRANT + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", MIT_GRANT),
    *[(f"GPL-{v}.0", f"This work is licensed under the GNU General Public License, version {v}.") for v in "123"],
    *[(f"LGPL-{v}", f"This work is licensed under the GNU Lesser General Public License, version {v.removesuffix('.0')}.") for v in ("2.1", "3.0")],
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    *[(f"GPL-{v}.0-or-later", gnu_notice("program", "General Public License", v)) for v in "123"],
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-2.0-or-later", gnu_notice("library", "Library General Public License", "2")),
    *[(f"LGPL-{v}-or-later", gnu_notice("library", "Lesser General Public License", v.removesuffix(".0"))) for v in ("2.1", "3.0")],
    ("AGPL-3.0-or-later", gnu_notice("program", "Affero General Public License", "3")),
    *[(f"CC-{k}-{v}", f"Licensed under CC {k} {v}.") for k in CC for v in ("4.0", "3.0", "2.5", "2.0", "1.0")],
    *[(f"CC-{k}-{v}", f"This work is licensed under a Creative Commons {words} {v} {port} License.") for k, words in CC.items()
      for v, port in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic"), ("1.0", "Generic"))],
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("BSD-2-Clause OR BSD-3-Clause", BSD_FIRST),
    ("BSD-2-Clause", f"{BSD_FIRST} {BSD_SECOND} {BSD_END}"),
    ("BSD-3-Clause", f"{BSD_FIRST} {BSD_SECOND} {BSD_THIRD} {BSD_END}"),
    ("BSD-2-Clause", f"{BSD_FIRST.replace('met: ', 'met: 1. ')} 2. {BSD_SECOND} {BSD_END}"),
    ("BSD-3-Clause", f"{BSD_FIRST.replace('met: ', 'met: 1. ')} 2. {BSD_SECOND} 3. {BSD_THIRD} {BSD_END}"),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *[(f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))],
]


def gram_hashes(ids: np.ndarray) -> np.ndarray:
    """Of every run of GRAM words; runs with a word of no template get the greatest value, which is in no template."""
    n = len(ids) - GRAM + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    h, known = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for k in range(GRAM):
        part = ids[k : k + n].astype(np.uint64)
        known &= part > 0
        h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.where(known, h >> np.uint64(1), np.uint64(2**64 - 1))


def winnow(h: np.ndarray) -> np.ndarray:
    """Places of the fingerprints: of each window of WINDOW hashes the least, of equals the rightmost. Fewer hashes are one window."""
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    w = min(WINDOW, len(h))
    views = np.lib.stride_tricks.sliding_window_view(h, w)
    return np.unique(np.arange(len(views)) + w - 1 - views[:, ::-1].argmin(axis=1))


def room(n: int) -> int:
    """Words that may lie between those of a template of ``n``, which a passed-over word makes dearer by 1 / room to match around."""
    return max(6, n // 2)


class Index:
    """Inverted index of the templates' fingerprints, and the runs of words of each."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [n for n, _ in templates]
        words = [words_of(t.encode()) for _, t in templates]
        self.vocab: dict[bytes, int] = {}
        self.ids = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws], dtype=np.int64) for ws in words]
        self.sizes = np.array([len(ids) for ids in self.ids], dtype=np.int64)
        self.numbers = [{i for w, i in zip(ws, ids.tolist()) if w.isdigit()} if len(ws) <= NOTICE else set() for ws, ids in zip(words, self.ids)]
        self.marks = np.array(sorted(self.vocab[w] for m in MARKS if (w := m.encode()) in self.vocab), dtype=np.int64)
        at: dict[int, list[tuple[int, int]]] = {}
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        for k, ids in enumerate(self.ids):
            h = gram_hashes(ids)
            order = np.argsort(h, kind="stable")
            self.grams.append((h[order], order))
            for i in winnow(h):
                at.setdefault(int(h[i]), []).append((k, int(i)))
        self.keys = np.array(sorted(at), dtype=np.uint64)
        self.first = np.cumsum([0, *(len(at[h]) for h in self.keys.tolist())])
        self.at = np.array([x for h in self.keys.tolist() for x in at[h]], dtype=np.int64).reshape(-1, 2)

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(template, place in the text where the template would start): of the diagonals that fingerprints name, the one that most do
        of those that an alignment would cover together. Places around which the text has too few words of any template are none."""
        h = gram_hashes(ids)
        known = h != np.uint64(2**64 - 1)
        if not known.any():
            return []
        w = min(WINDOW, len(h))
        some = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(known, w).any(axis=1))  # other windows are passed over
        views = np.lib.stride_tricks.sliding_window_view(h, w)[some]
        picked = np.unique(some + w - 1 - views[:, ::-1].argmin(axis=1))
        key = np.searchsorted(self.keys, h[picked])
        ok = self.keys[np.minimum(key, len(self.keys) - 1)] == h[picked]
        picked, key = picked[ok], key[ok]
        n = self.first[key + 1] - self.first[key]
        k, i = self.at[np.arange(n.sum()) + np.repeat(self.first[key] - np.cumsum(n) + n, n)].T
        start, size = np.repeat(picked, n) - i, self.sizes[k]
        free = np.maximum(6, size // 2)
        words = np.r_[0, np.cumsum(ids > 0)]
        ok = words[np.clip(start + size + free, 0, len(ids))] - words[np.clip(start - free, 0, len(ids))] >= COVERAGE * size - 1e-6
        pairs, often = np.unique(np.stack([k[ok], start[ok]]), axis=1, return_counts=True)
        out: list[tuple[int, int]] = []
        for k in np.unique(pairs[0]).tolist():
            own = pairs[0] == k
            starts, counts = pairs[1][own], often[own]
            n = int(self.sizes[k])
            reach, taken = min(room(n) // 2, n - 1), []
            for j in np.lexsort((starts, -counts)).tolist():
                p, x = int(starts[j]), bisect_left(taken, int(starts[j]))
                if (x == len(taken) or taken[x] - p > reach) and (not x or p - taken[x - 1] > reach):
                    taken.insert(x, p)
                    out.append((k, p))
        return out

    def chain(self, k: int, h: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in template ``k``, places in the text) of the longest chain, in the order of both, of runs of GRAM words that they share,
        near the diagonal at ``start``; ``h`` are the hashes of the text's runs."""
        keys, place = self.grams[k]
        lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
        n = np.where(h == np.uint64(2**64 - 1), 0, hi - lo)
        p = np.repeat(np.arange(len(h)), n)
        i = place[np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)]
        near = np.abs(p - i - start) <= room(len(self.ids[k]))
        p, i = p[near], i[near]
        order = np.lexsort((-i, p))
        p, i = p[order], i[order]
        tails: list[int] = []
        last, before = [], []
        for j, x in enumerate(i.tolist()):
            c = bisect_left(tails, x)
            before.append(last[c - 1] if c else -1)
            tails[c : c + 1], last[c : c + 1] = [x], [j]
        found, j = [], last[-1] if last else -1
        while j >= 0:
            found.append(j)
            j = before[j]
        found.reverse()
        return i[found], p[found]

    def confirmed(self, k: int, ids: np.ndarray, h: np.ndarray, start: int, seen: dict[tuple, tuple | None]) -> tuple[int, int, float, int] | None:
        """(first word, end word, coverage, matched words) of the alignment of template ``k`` around ``start``, if it covers enough, holds a
        notice's numbers, and holds no words that make it another licence. What can't do so is not aligned. Coverage
        is the matched share of the template and of a quarter of the words between. ``seen`` holds what the chains so far came to: several
        candidates of a long template have one chain."""
        template, n = self.ids[k], len(self.ids[k])
        if start >= 0 and np.array_equal(ids[start : start + n], template):
            return start, start + n, 1.0, n
        lo, hi = max(0, start - room(n)), max(0, start + n + room(n))
        near = ids[lo:hi]
        if not self.numbers[k] <= set(near.tolist() if self.numbers[k] else ()):
            return None
        if np.count_nonzero(np.isin(template, near)) < COVERAGE * n:
            return None
        i, p = self.chain(k, h[lo : max(lo, hi - GRAM + 1)], start - lo)
        if not len(i) or n > NOTICE and GRAM + np.minimum(np.diff(i), GRAM).sum() < CHAINED * n:
            return None
        name = (k, len(i), lo + int(p[0]), lo + int(p[-1]))
        if name not in seen:
            seen[name] = self._judged(k, near, lo, i, p)
        return seen[name]

    def _judged(self, k: int, near: np.ndarray, lo: int, i: np.ndarray, p: np.ndarray) -> tuple[int, int, float, int] | None:
        n, found = len(self.ids[k]), align(self.ids[k], near, i, p)
        if found is None:
            return None
        at, between = found
        a, b, hits = int(at[0]), int(at[-1]) + 1, len(at)
        coverage = hits / (n + len(between) / 4)
        if coverage < COVERAGE - 1e-9 or not self.numbers[k] <= set(near[a:b].tolist()):
            return None
        others = np.count_nonzero(np.isin(near[between], self.marks)) if len(between) else 0
        own = np.count_nonzero(np.isin(near[at], self.marks)) if n > NOTICE else 0
        return None if others > own else (lo + a, lo + b, coverage, hits)

    def spans(self, ids: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(licence, first word, end word, coverage); of overlapping spans the one of the most matched words, then of the
        greatest coverage. A candidate that found a span which another took, or one that overlaps it, is aligned again to the words that are left."""
        kept: list[tuple[int, int, int, float]] = []
        left, ids = self.candidates(ids), ids.copy()
        while left:
            h = gram_hashes(ids)
            seen: dict[tuple, tuple | None] = {}
            found = [(k, *s, start) for k, start in left if (s := self.confirmed(k, ids, h, start, seen))]
            before, left = len(kept), []
            for k, a, b, c, hits, start in sorted(found, key=lambda f: (-f[4], -f[3], f[1], f[0])):
                if all(b <= g[1] or a >= g[2] for g in kept):
                    kept.append((k, a, b, c))
                else:
                    left.append((k, start))
            if len(kept) == before:
                break
            for _, a, b, _ in kept[before:]:
                ids[a:b] = 0
        return sorted((self.names[k], a, b, c) for k, a, b, c in kept)


def align(template: np.ndarray, text: np.ndarray, i: np.ndarray, p: np.ndarray, band: int = BAND) -> tuple[np.ndarray, np.ndarray] | None:
    """(places of the matched words in the text, places of the words between them) of the best alignment along the chain of
    places ``i`` of the template and ``p`` of the text; None if nothing matches.

    A matched word counts 1, a word of the text between matched ones costs 1 / room, a word of the template without a
    counterpart nothing. Between two links of the chain the band reaches from the diagonal of the one to that of the other, and
    ``band`` words further; before the first and after the last it reaches as far as a matched word pays for. (Links stand at
    the first word of their run, so both diagonals are open at a link as well.)"""
    n, m, free = len(template), len(text), room(len(template))
    cost = 1 / free
    t = np.arange(n)
    before, after = np.searchsorted(i, t, "left") - 1, np.searchsorted(i, t, "right")  # links before and after each word of the template
    shift = p - i
    here, there = shift[np.maximum(before, 0)], shift[np.minimum(after, len(i) - 1)]
    own = np.where(after - before > 1, shift[np.minimum(before + 1, len(i) - 1)], np.where(before < 0, there, here))
    low = np.minimum(own, np.where(before < 0, own - free, here))
    low = np.minimum(low, np.where(after == len(i), own, there)) + t - band
    high = np.maximum(own, np.where(before < 0, own, here))
    high = np.maximum(high, np.where(after == len(i), own + free, there)) + t + band
    low, high = np.clip(low, 0, m), np.clip(high + 1, 0, m)
    score, at, steps = np.zeros(0), 0, []
    for k in range(n):
        lo, hi = int(low[k]), int(max(low[k], high[k]))
        j = np.arange(lo, hi + 1)  # words of the text read so far
        held = np.zeros(hi - lo + 2)  # scores of the row above, from lo - 1 on
        a, b = max(at, lo - 1), min(at + len(score), hi + 1)
        if a < b:
            held[a - lo + 1 : b - lo + 1] = score[a - at : b - at]
        same = np.zeros(len(j), dtype=bool)
        same[int(lo == 0) :] = text[max(lo - 1, 0) : hi] == template[k]
        up, across = held[1:], held[:-1] + 1
        match = same & (across >= up)
        best = np.where(match, across, up)
        score, at = np.maximum.accumulate(best + cost * j) - cost * j, lo
        step = np.where(score > best + 1e-9, 3, np.where(match, 2, 1)).astype(np.int8)
        step[score <= 1e-9] = 0
        score = np.maximum(score, 0.0)
        steps.append(step)
    if not len(score) or score.max() <= 1e-9:
        return None
    j, k = at + int(score.argmax()), n - 1
    found, between = [], []
    while k >= 0:
        x = j - int(low[k])
        step = steps[k][x] if 0 <= x < len(steps[k]) else 0
        if step == 0:
            break
        if step == 3:
            between.append(j - 1)
            j -= 1
            continue
        if step == 2:
            found.append(j - 1)
            j -= 1
        k -= 1
    return np.array(found[::-1]), np.array(between[::-1], dtype=np.int64)


_INDEX: dict[int, Index] = {}


def licence_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(id, n_spans, licences, coverage, spans) of each row: spans as licence:start:end:coverage in code
    points, licences distinct and sorted, coverage the greatest.

    Texts are cut to words in lower case. A null or wordless text has no spans and coverage 0; very long texts
    are searched whole, one at a time; repeated rows get equal results; of overlapping spans that tie in words
    and share the first stays, then the one of the earlier template. Templates of fewer than GRAM words match nothing.
    Columns other than the two are not read, whatever they are called; an empty table gives an empty result.
    """
    key = zlib.crc32(repr(templates).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _INDEX.get(key) or _INDEX.setdefault(key, Index(templates))
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for t in batch.column(1).cast(pa.large_binary()):
                data = t.as_buffer().to_pybytes() if t.is_valid else b""
                words = words_of(data)
                spans = index.spans(np.fromiter(map(index.vocab.get, words, repeat(0)), dtype=np.int64, count=len(words)))
                said = []
                if spans:
                    places = [(m.start(), m.end()) for m in WORD.finditer(data.decode())]
                    said = sorted((places[a][0], places[b - 1][1], n, c) for n, a, b, c in spans)
                columns[0].append(len(said))
                columns[1].append(",".join(sorted({n for *_, n, _ in said})))
                columns[2].append(max((c for *_, c in said), default=0.0))
                columns[3].append(",".join(f"{n}:{a}:{b}:{c:.3f}" for a, b, n, c in said))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.string())))],
                                             names=[id_col, "n_spans", "licences", "coverage", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, n_spans bigint, licences string, coverage double, spans string")
