"""License scans: templates as compression dictionaries, then exact wording differences."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession

from ._shared import bounded_batches, table

#: Short forms of public licence notices, and whole texts of short licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT (text)", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC (text)", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0 (notice)", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0 (notice)", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
)
OTHER = re.compile(r"[^a-z0-9]+")
FOUND = "doc_id long, license string, start long, n_words long, reduction double, missing array<string>, added array<string>"


def wording(text: str) -> list[str]:
    """Lower-case runs of a-z and 0-9."""
    return OTHER.sub(" ", text.lower()).split()


def aligned(want: Sequence[str], have: Sequence[str]) -> tuple[int, int, int, list[str], list[str]]:
    """(differences, begin, end, missing, added) of the stretch of `have` that words `want` best.

    Differences are words of `want` that the stretch lacks and words that it has besides; of
    equally good stretches the first to end counts, without words before or after that don't count.
    """
    rows = [[0] * (len(have) + 1)]
    for i, w in enumerate(want, 1):
        before, row = rows[-1], [i]
        for j, h in enumerate(have):
            row.append(before[j] if w == h else min(before[j + 1], row[j]) + 1)
        rows.append(row)
    end = min(range(len(have) + 1), key=rows[-1].__getitem__)
    i, j = len(want), end
    missing, added = [], []
    while i:
        if j and want[i - 1] == have[j - 1]:
            i, j = i - 1, j - 1
        elif j and rows[i][j] == rows[i][j - 1] + 1:
            j -= 1
            added.append(have[j])
        else:
            i -= 1
            missing.append(want[i])
    return rows[-1][end], j, end, missing[::-1], added[::-1]


class Scanner:
    """Finds blocks of a text that word a template, but for up to `most` of its words.

    A template of n words may have d = most * n differences, words missing or added. Cut into
    d + 1 parts, it has a part that such a block holds word for word, as each difference
    breaks one part at most: those parts are looked up, so no block is missed. Around each hit
    the block grows and shrinks by d words to where it words the template best. It is then
    compressed with each template as a raw dictionary and without; templates are ranked by the
    share of bytes saved, and the first is taken whose own differences from the wording
    around are few enough.
    """

    def __init__(self, templates: Sequence[tuple[str, str]], most: float = 0.2) -> None:
        self.words = {name: wording(t) for name, t in templates}
        self.slack = {name: int(most * len(ws)) for name, ws in self.words.items()}
        self.find = ahocorasick.Automaton()
        seeds: dict[str, list[tuple[str, int]]] = {}
        for name, ws in self.words.items():
            parts = self.slack[name] + 1
            cuts = [len(ws) * k // parts for k in range(parts + 1)]
            for i, j in zip(cuts, cuts[1:]):
                seeds.setdefault(f" {' '.join(ws[i:j])} ", []).append((name, i))
        for s, at in seeds.items():
            self.find.add_word(s, (len(s), at))
        self.find.make_automaton()
        self.plain = zstandard.ZstdCompressor(level=19, write_content_size=False)
        raw = {n: zstandard.ZstdCompressionDict(" ".join(ws).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for n, ws in self.words.items()}
        self.knowing = {n: zstandard.ZstdCompressor(level=19, dict_data=d, write_content_size=False, write_dict_id=False) for n, d in raw.items()}

    def reduction(self, name: str, block: bytes, alone: int) -> float:
        return 1 - len(self.knowing[name].compress(block)) / alone

    def around(self, ws: list[str], name: str, low: int, high: int) -> tuple[int, int, int, list[str], list[str]]:
        """The best wording of a template that begins within its slack of low to high."""
        low = max(0, low - self.slack[name])
        diff, a, b, missing, added = aligned(self.words[name], ws[low : high + len(self.words[name]) + self.slack[name]])
        return diff, low + a, low + b, missing, added

    def judged(self, ws: list[str], a: int, b: int) -> tuple | None:
        """(differences, -saved, begin, end, license, missing, added) of the block by the best ranked template that words it."""
        block = " ".join(ws[a:b]).encode()
        alone = len(self.plain.compress(block))
        for saved, name in sorted(((self.reduction(n, block, alone), n) for n in self.words), reverse=True):
            diff, i, j, missing, added = self.around(ws, name, a, a)
            if diff <= self.slack[name]:
                return diff, -saved, i, j, name, missing, added
        return None

    def scan(self, text: str | None) -> list[tuple]:
        """(license, start, n_words, reduction, missing, added) of each block, in order, without overlaps; fewest differences first."""
        ws = wording(text or "")
        flat = f" {' '.join(ws)} "
        if not ws:
            return []
        starts: dict[str, list[int]] = {}
        at, last = -1, 0
        for end, (n, owners) in self.find.iter(flat):
            begin = end - n + 1
            at += flat.count(" ", last, begin + 1)
            last = begin + 1
            for name, i in owners:
                starts.setdefault(name, []).append(max(0, at - i))
        blocks: set[tuple[int, int]] = set()
        for name, own in starts.items():
            run = []
            for x in [*sorted(own), None]:  # hits that may be of one block are looked at together
                if run and (x is None or x - run[0] > self.slack[name]):
                    diff, a, b, _, _ = self.around(ws, name, run[0], run[-1])
                    if diff <= self.slack[name]:
                        blocks.add((a, b))
                    run = []
                run.append(x)
        best = sorted(j for a, b in sorted(blocks) if (j := self.judged(ws, a, b)) is not None)
        out: list[tuple[int, int, tuple]] = []  # kept in order of their places, so each asks its neighbours alone
        for _, saved, a, b, name, missing, added in best:
            k = bisect.bisect_left(out, (a,))
            if (k == 0 or out[k - 1][1] <= a) and (k == len(out) or out[k][0] >= b):
                out.insert(k, (a, b, (name, a, b - a, round(-saved, 6), missing, added)))
        return [row for _, _, row in out]


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, most: float = 0.2) -> DataFrame:
    """Licence notices in whole texts (doc_id, text), one row each, without overlaps.

    start counts words from 0. missing and added are the words in which the block differs
    from the template. Null and empty texts have none; of blocks as good as each other the first
    counts; rows alike have the same notices each; no rows give none; long texts are read whole,
    their words being held by a task; other columns of any name don't matter.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, most)
        for b in batches:
            yield pd.DataFrame([(d, *x) for d, t in zip(b.doc_id, b.text) for x in scanner.scan(t)], columns=["doc_id", "license", "start", "n_words", "reduction", "missing", "added"])

    return docs.select("doc_id", "text").mapInPandas(run, FOUND)


def op7_conditional_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all `documents`."""
    bounded_batches(spark)
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op7_conditional_compression": op7_conditional_compression}
ORACLES: dict[str, str] = {}
