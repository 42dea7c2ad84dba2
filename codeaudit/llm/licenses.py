"""License scans: patience alignment of texts with license templates.

A template of n words is found where an alignment covers at least `least` = 0.8 of
them within `SPREAD` n = 2 n words of text: as many words as it has may be
strewn in.  Words are runs of letters, digits and underscores, lower-cased.

Seeds.  An alignment of that coverage may miss at most n - ceil(0.8 n) of the
template's n words, so of its n - ceil(0.8 n) + 1 longest ones at least one is
met; texts without any are left alone.  Each occurrence of such a word proposes
the place in the text where the template would lie, a window a quarter of its
length wider on both sides, and, from the first to the last seed of a cluster, windows
that hold every span of 2 n words with a seed in it.

Alignment.  Equal ends of the two ranges are matched.  In between, the words that
occur once in both anchor the alignment: the longest increasing run of anchors is
kept and the gaps between them are aligned the same way.  A gap without anchors
matches nothing more.  Of overlapping finds of one template the one with most
words stays (then the shortest, then the first).

Defined results: null and empty texts have no finds.  Repeated rows are scanned
one by one; a null doc_id is carried.  Empty tables give empty results; other
columns do not take part.  Texts are read whole, in overlapping stretches of
bounded length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

LEAST, SPREAD = 0.8, 2
STRETCH = 200_000
WORDS = re.compile(r"\w+")
# --- Fixed values: wordings of licenses and of their notices ------------------------
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software.""",
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "GPL notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "GPL-2.0 notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any
        later version.""",
    "LGPL notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)
        any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "AGPL notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version.""",
    "MPL-2.0 notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this
        work.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
        "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
        OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
        IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
        EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
        USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
        LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
        OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause condition": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
        not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. 3. This notice may not be removed or altered from any source distribution.""",
    "BSD notice": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer.""",
}
# --- end of fixed values ------------------------------------------------------------


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence: cards are dealt on piles, each keeping the top to its left."""
    tops: list[int] = []
    top_at: list[int] = []
    before = [-1] * len(values)
    for i, value in enumerate(values):
        pile = bisect_left(tops, value)
        before[i] = top_at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(value)
            top_at.append(i)
        else:
            tops[pile], top_at[pile] = value, i
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched places (in text, in template), increasing in both."""
    matched: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(template[c:d], c) if there[w] == 1 and here[w] == 1}
        common = [(i, place[w]) for i, w in enumerate(text[a:b], a) if w in place]
        anchors = [common[i] for i in longest_increasing([j for _, j in common])]
        if not anchors:
            continue
        matched += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(matched)


class Template:
    def __init__(self, name: str, text: str, least: float = LEAST):
        self.name, self.words = name, WORDS.findall(text.lower())
        n = len(self.words)
        self.need = math.ceil(n * least - 1e-9)
        self.slack = max(4, n // 4)
        chosen = sorted(range(n), key=lambda i: (-len(self.words[i]), self.words[i], i))[: n - self.need + 1]
        self.seeds: dict[str, list[int]] = {}
        for i in sorted(chosen):
            self.seeds.setdefault(self.words[i], []).append(i)

    def windows(self, at: dict[str, list[int]]) -> list[tuple[int, int]]:
        """The ranges of a text in which the template is aligned."""
        n = len(self.words)
        out, last = [], None
        for start in sorted({p - q for seed, places in self.seeds.items() for p in at.get(seed, ()) for q in places}):
            # The exact place first: there, copies side by side do not rob each other of their unique words.
            out.append((start, start + n))
            if last is None or start - last >= max(1, self.slack // 2):
                last = start
                out.append((start - self.slack, start + n + self.slack + self.slack // 2))
        seeds = sorted(p for seed in self.seeds for p in at.get(seed, ()))
        reach, step = SPREAD * n, max(1, n // 2)
        k = 0
        while k < len(seeds):
            # Seeds up to `step` further on are held by the same window.
            first = seeds[k]
            while k < len(seeds) and seeds[k] <= first + step:
                k += 1
            out.append((first - reach, seeds[k - 1] + reach))
        return out

    def densest(self, matched: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The part of an alignment that lies within SPREAD n words and matches most; of several the shortest, then the first."""
        best, low = (0, 0, 0, 0), 0
        for high, (i, _) in enumerate(matched):
            while i - matched[low][0] >= SPREAD * len(self.words):
                low += 1
            best = max(best, (high - low + 1, matched[low][0] - i, -low, high))
        return matched[-best[2]: best[3] + 1]

    def finds(self, words: list[str], at: dict[str, list[int]]) -> list[tuple[int, int, int]]:
        """(first word, words spanned, words matched) of the finds in words; `at` has the places of the seed words."""
        found = set()
        for low, high in self.windows(at):
            low = max(0, low)
            matched = align(words[low:max(0, high)], self.words)
            if len(matched) >= self.need:
                matched = self.densest(matched)
            if len(matched) >= self.need:
                first, final = low + matched[0][0], low + matched[-1][0]
                found.add((first, final - first + 1, len(matched)))
        return list(found)


def _apart(found: set[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """Finds of each template that do not overlap: most words first, then the shortest, then the first."""
    kept: dict[str, list[tuple[int, int, int]]] = {}
    for name, first, span, matched in sorted(found, key=lambda f: (f[0], -f[3], f[2], f[1])):
        mine = kept.setdefault(name, [])
        if all(first + span <= a or a + b <= first for a, b, _ in mine):
            mine.append((first, span, matched))
    return sorted((name, *f) for name, some in kept.items() for f in some)


def scan_text(text: str | None, templates: list[Template], stretch: int = STRETCH) -> list[tuple[str, int, int, int]]:
    """(template, first word, words spanned, words matched) of all finds in a text."""
    seeds = set().union(*(t.seeds for t in templates)) if templates else set()
    overlap = max(((2 * SPREAD + 1) * len(t.words) for t in templates), default=0)
    found: set[tuple[str, int, int, int]] = set()
    words: list[str] = []
    base = 0

    def look() -> None:
        if seeds.isdisjoint(words):
            return
        at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in seeds:
                at.setdefault(w, []).append(i)
        for t in templates:
            found.update((t.name, base + first, span, matched) for first, span, matched in t.finds(words, at))

    for match in WORDS.finditer((text or "").lower()) if len(text or "") > 8 * stretch else ():
        words.append(match[0])
        if len(words) >= stretch + overlap:
            look()
            base += len(words) - overlap
            words = words[-overlap:] if overlap else []
    if len(text or "") <= 8 * stretch:
        words = WORDS.findall((text or "").lower())
    look()
    return _apart(found)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, license, coverage, first_word, words, matched for every find in docs."""
    known = [Template(name, text, least) for name, text in (TEMPLATES if templates is None else templates).items()]
    known = [t for t in known if t.words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = {t.name: len(t.words) for t in known}
        for batch in batches:
            rows = [(doc_id, name, matched / sizes[name], first, span, matched)
                    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1))
                    for name, first, span, matched in scan_text(text.as_py(), known)]
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)],
                                             names=["doc_id", "license", "coverage", "first_word", "words", "matched"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, license string, coverage double, first_word long, words long, matched long")
