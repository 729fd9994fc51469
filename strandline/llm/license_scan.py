"""License scans: MinHash over overlapping text windows retrieves templates, exact shingle containment verifies them.

Texts and templates become shingles of five words (lower case, without punctuation). For each size class m = 4, 8, 16 ... the
shingles of a text fall into blocks of m; every two neighbouring blocks are a window, so that any place of a template of at most
m shingles lies within a window. With one row a band and 64 bands, a window with Jaccard similarity s agrees in a band with a
probability of 1 - (1 - s)^64. A template (n shingles, m below 2 n) with at least 0.8 of its shingles in a window has s of 1/8 or
more there: 0.9998. One that inserted text has torn in two has at least half of them in a window, s of 1/9 and more: 0.9995;
torn in four, s of 1/17 in each of four windows: 0.98 for each, 0.999 for one of them.

A template that any window retrieves is verified exactly: where a window, widened by the template's length on both sides, has 0.8
or more of its shingles, that place is reported; where none has, the whole text is looked at, and the template is reported from
its first shingle to its last if 0.8 or more of its shingles are in the text.

Templates are a parameter: name to text, at least five words each, a bounded set sent to the workers.

Defined cases: a null or empty text, and one of under five words, has no license; a template is reported once per text, at its
best unbroken place (the first on a tie) if it has one; repeated rows get equal results; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import bytes_of

SHINGLE, LEAST, BANDS, SMALLEST = 5, 0.8, 64, 4
#: Public license notices (fixed values).
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0",
    "MIT line": "Released under the MIT License",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "Apache-2.0 header": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language '
    "governing permissions and limitations under the License.",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions",
    "BSD redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
    "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "LGPL header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
    "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "EPL-2.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
    "available at https://www.eclipse.org/legal/epl-2.0/",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
    "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
    "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
    "SOFTWARE.",
    "BSD-2-Clause": _BSD + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. " + _BSD_WARRANTY,
    "MIT warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
    "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by "
    "any means.",
    "CC0-1.0 notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this "
    "software to the public domain worldwide. This software is distributed without any warranty.",
}
_PUNCTUATION = b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""


def shingles(text: str | None) -> np.ndarray:
    """The hash of each five words in a row."""
    from xxhash import xxh64_intdigest as h

    words = bytes_of(text).lower().translate(None, _PUNCTUATION).split()
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = [0, *ends[: n - 1].tolist()]
    return np.array([h(joined[a:b]) for a, b in zip(begins, (ends[SHINGLE - 1 :] - 1).tolist())], np.uint64)


def _parameters(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.random.default_rng(seed).integers(0, 1 << 63, size=(2, BANDS), dtype=np.uint64)
    return numbers[0] * np.uint64(2) + np.uint64(1), numbers[1]


def _halves(minima: np.ndarray) -> np.ndarray:
    """The lesser of each two rows in a row."""
    if len(minima) % 2:
        minima = np.concatenate([minima, minima[-1:]])
    return np.minimum(minima[0::2], minima[1::2])


def block_minima(hashes: np.ndarray) -> np.ndarray:
    """For each block of SMALLEST shingles (rows) and band (columns), the least of the band's hash."""
    a, b = _parameters()
    out = []
    for at in range(0, len(hashes), 1024):
        rows = hashes[at : at + 1024, None] * a
        rows += b
        for _ in range(SMALLEST.bit_length() - 1):
            rows = _halves(rows)
        out.append(rows)
    return np.concatenate(out)


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.sets = [np.unique(shingles(templates[n])) for n in self.names]
        if any(not len(s) for s in self.sets):
            raise ValueError("a template has under five words")
        self.classes: dict[int, list[int]] = {}
        for t, s in enumerate(self.sets):
            m = max(SMALLEST, 1 << (len(s) - 1).bit_length())
            self.classes.setdefault(m, []).append(t)
        self.minima = [block_minima(s).min(axis=0) for s in self.sets]
        # per class: for the low 16 bits of a band's value, whether a template has such a value
        self.hints = {}
        for m, members in self.classes.items():
            hint = np.zeros((BANDS, 1 << 16), bool)
            for t in members:
                hint[np.arange(BANDS), (self.minima[t] & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.hints[m] = hint

    def retrieved(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, first shingle, end shingle) of the windows that agree with it in a band."""
        out, size, minima = [], SMALLEST, block_minima(hashes)
        first = np.arange(BANDS) << 16
        while True:
            if size in self.classes:
                windows = np.minimum(minima[:-1], minima[1:]) if len(minima) > 1 else minima
                maybe = self.hints[size].take((windows & np.uint64(0xFFFF)).astype(np.int64) + first).any(axis=1)
                for w in np.flatnonzero(maybe).tolist():
                    for t in self.classes[size]:
                        if (windows[w] == self.minima[t]).any():
                            out.append((t, w * size, min((w + 2) * size, len(hashes))))
            if size >= max(self.classes):
                return out
            size *= 2
            minima = _halves(minima)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template's name, containment, first word, end word), by name."""
        hashes = shingles(text)
        if not len(hashes):
            return []
        best: dict[int, tuple[float, int, int]] = {}
        found = self.retrieved(hashes)
        for t, a, b in found:
            own = self.sets[t]
            a, b = max(0, a - len(own)), min(len(hashes), b + len(own))
            at = np.flatnonzero(np.isin(hashes[a:b], own))
            share = len(np.unique(hashes[a + at])) / len(own)
            if share >= LEAST and share > best.get(t, (0.0,))[0]:
                best[t] = (share, int(a + at[0]), int(a + at[-1]) + SHINGLE)
        for t in {t for t, _, _ in found}.difference(best):  # no unbroken place
            own = self.sets[t]
            at = np.flatnonzero(np.isin(hashes, own))
            share = len(np.unique(hashes[at])) / len(own)
            if share >= LEAST:
                best[t] = (share, int(at[0]), int(at[-1]) + SHINGLE)
        return [(self.names[t], *best[t]) for t in sorted(best)]


FOUND = ArrayType(StructType([StructField("template", StringType()), StructField("containment", DoubleType()), StructField("start_word", LongType()), StructField("end_word", LongType())]))
_FOUND = pa.list_(pa.struct([("template", pa.string()), ("containment", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())]))
_scanners: dict[tuple, Scanner] = {}


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and licenses, an array of struct<template, containment, start_word, end_word>."""

    def find(texts: pa.Array) -> pa.Array:
        key = tuple(sorted(templates.items()))
        if key not in _scanners:
            _scanners[key] = Scanner(templates)
        fields = ("template", "containment", "start_word", "end_word")
        return pa.array([[dict(zip(fields, x)) for x in _scanners[key].scan(t.as_py())] for t in texts], _FOUND)

    return docs.select(F.col(id_col), F.arrow_udf(find, FOUND)(text_col).alias("licenses"))
