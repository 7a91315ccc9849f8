"""Licence texts and notices in documents.

Method: shingles of the templates' words are winnowed into fingerprints in an
inverted index.  Fingerprints of a document, winnowed alike, that are in the
index pick candidates, a template at an offset; a banded sequence alignment of
the template with the words there tells how much of it is covered, and where.
Every offset of a candidate is aligned, so that copies side by side are each
found.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_texts, slices
from .decontaminate import words_of

#: Words of a shingle, shingles of a winnowing window: any shared run of SHINGLE + WINDOW - 1 words shares a fingerprint.
SHINGLE, WINDOW = 2, 2
#: Least share of a template's words that must align, and of its fingerprints that make a candidate.
COVERAGE, SEED = 0.8, 0.4
#: Width of the alignment band, as a share of the template's words, and at least.
BAND, BAND_WORDS = 0.15, 4

# Public licence notices and texts.
TEMPLATES = {
    "All rights reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": "Released under the MIT License.",
    "MIT text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}


def winnowed(hashes: list[int], window: int = WINDOW) -> list[int]:
    """Places of the fingerprints: in each window the last least hash; a shorter list is one window."""
    out: list[int] = []
    for lo in range(max(1, len(hashes) - window + 1) if hashes else 0):
        some = range(lo, min(lo + window, len(hashes)))
        at = min(some, key=lambda i: (hashes[i], -i))
        if not out or out[-1] != at:
            out.append(at)
    return out


def aligned(template: list[bytes], words: list[bytes], offset: int, band: int) -> tuple[int, int, int]:
    """Matched words, and the span [start, end) of words, of the best alignment of the
    whole template with words, where word i of it lies within band of word i + offset.

    Best: fewest edits (words changed, added, left out), then most matches, then
    the start nearest to offset, then the first.
    """
    n = len(template)
    if offset >= 0 and words[offset : offset + n] == template:
        return n, offset, offset + n
    width, far = 2 * band + 1, (1 << 30, 0, 0, 0)
    # (edits, -matches, start's distance, start) of a prefix of the template that ends before word i + offset - band + c
    row = [(0, 0, abs(j - offset), j) if 0 <= (j := offset - band + c) <= len(words) else far for c in range(width)]
    for i in range(1, n + 1):
        new = []
        for c in range(width):
            j = i + offset - band + c
            best = far
            if 0 <= j <= len(words):
                if j and row[c] is not far:
                    e, m, d, s = row[c]
                    best = (e, m - 1, d, s) if template[i - 1] == words[j - 1] else (e + 1, m, d, s)
                if c + 1 < width and row[c + 1] is not far:  # the template's word is left out
                    e, m, d, s = row[c + 1]
                    best = min(best, (e + 1, m, d, s))
                if c and new[c - 1] is not far:  # a word is added
                    e, m, d, s = new[c - 1]
                    best = min(best, (e + 1, m, d, s))
            new.append(best)
        row = new
    e, m, _, start, c = min((*x, c) for c, x in enumerate(row))
    return -m, start, n + offset - band + c


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.templates = {name: words_of(text.encode()) for name, text in sorted(templates.items())}
        self.templates = {n: w for n, w in self.templates.items() if w}
        self.vocabulary = {w for words in self.templates.values() for w in words}
        #: fingerprint: templates and places; the second one is of templates too short for a winnowing window
        self.index: dict[int, list[tuple[str, int]]] = defaultdict(list)
        self.short: dict[int, list[tuple[str, int]]] = defaultdict(list)
        self.prints: dict[str, int] = {}
        for name, words in self.templates.items():
            hashes = self._hashes(words)
            places, index = (winnowed(hashes), self.index) if len(hashes) >= WINDOW else (range(len(hashes)), self.short)
            self.prints[name] = len(places)
            for i in places:
                index[hashes[i]].append((name, i))

    @staticmethod
    def _hashes(words: list[bytes]) -> list[int]:
        return [zlib.crc32(b" ".join(words[i : i + SHINGLE])) for i in range(max(1, len(words) - SHINGLE + 1))]

    def _seeds(self, words: list[bytes]) -> dict[str, list[tuple[int, int]]]:
        """Offsets and places of fingerprints, by template."""
        known, hits = self.vocabulary, defaultdict(list)
        # a fingerprint in the index lies in an unbroken run of words that templates have
        at = [i for i, w in enumerate(words) if w in known]
        lo = 0
        while lo < len(at):
            hi = lo
            while hi + 1 < len(at) and at[hi + 1] == at[hi] + 1:
                hi += 1
            first = at[lo]
            hashes = self._hashes(words[first : at[hi] + 1])
            for index, places in ((self.index, winnowed(hashes)), (self.short, range(len(hashes)) if self.short else ())):
                for k in places:
                    for name, place in index.get(hashes[k], ()):
                        hits[name].append((first + k - place, place))
            if self.short and hi > lo:  # a template of one word
                for k in at[lo : hi + 1]:
                    for name, place in self.short.get(zlib.crc32(words[k]), ()):
                        hits[name].append((k - place, place))
            lo = hi + 1
        return hits

    def scan(self, text: bytes) -> list[tuple[str, float, int, int]]:
        """(template, share of its words that match, first word, word after the last), by place; of spans that
        overlap the one with most matched words stays."""
        words = words_of(text)
        found = set()
        for name, seeds in self._seeds(words).items():
            template = self.templates[name]
            band = min(max(BAND_WORDS, int(BAND * len(template))), max(1, len(template) - 1))
            need = max(1, SEED * self.prints[name])
            seeds.sort()
            # offsets in a window of the band's width that has seeds enough
            places: Counter = Counter()
            offsets, lo = set(), 0
            for hi, (offset, place) in enumerate(seeds):
                places[place] += 1
                while offset - seeds[lo][0] > band:
                    places[seeds[lo][1]] -= 1
                    if not places[seeds[lo][1]]:
                        del places[seeds[lo][1]]
                    lo += 1
                if len(places) >= need:
                    offsets.update(o for o, _ in seeds[lo : hi + 1] if o not in offsets)
            for offset in offsets:
                matched, start, end = aligned(template, words, offset, band)
                if matched >= COVERAGE * len(template):
                    found.add((-matched, end - start, start, name, end))
        kept: list[tuple[str, float, int, int]] = []
        for matched, _, start, name, end in sorted(found):
            if all(end <= k[2] or start >= k[3] for k in kept):
                kept.append((name, -matched / len(self.templates[name]), start, end))
        return sorted(kept, key=lambda k: k[2:])


_FOUND = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", out: str = "licenses") -> DataFrame:
    """docs with licenses: array of (license, coverage, start, end), spans in words from 0. No shuffle.

    Null and empty texts have none.  Templates without a word are left out.
    """
    templates = TEMPLATES if templates is None else templates
    rest = [f for f in docs.schema.fields if f.name != out]
    names = [f.name for f in rest]
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for part in slices(batches, text):
            found = [[dict(zip(("license", "coverage", "start", "end"), x, strict=True)) for x in scanner.scan(t)] for t in binary_texts(part.column(text))]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(found, kind)], names=[*names, out])

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField(out, _FOUND)]))


def summary(column: str = "licenses"):
    """The licences and spans of scan() as one text."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ";")
