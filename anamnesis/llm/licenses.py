"""License scans: templates found in texts, with matched coverage and spans.

Templates are cut into words (letters and digits, lower case); every GRAM
words in a row have a hash, and of every WINDOW neighbouring hashes the least
is a fingerprint (winnowing), so any GRAM + WINDOW - 1 words of a template that
a text repeats hold a fingerprint.  The inverted index leads from a fingerprint
to its templates and places.  Hits of one template on near diagonals make a
candidate; it is aligned with the text in a band from BAND words before its
first diagonal to BAND words after its last one (words replaced, left out and
put in cost one each; the text before and after is free), and again without the
words of each match.  Matches that cover MIN_COVERAGE of a template count if
the text between their ends names the same kinds (Lesser, Affero, NC, ND, SA,
clauses) and versions as the template, and no less than its names; where matches
overlap, the one with more words stays.  Ids of SPDX lines are matches of
their own.

The templates are a parameter: name -> text.  The index is as large as they
are; it is sent to the executors, and every text is read whole, once, without
a shuffle.

Defined cases: a null or empty text has no matches, a text with a template
several times has several matches, repeated rows give equal results, without
templates nothing matches, an empty table gives an empty table, extra columns
are carried along by ``scan``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from hashlib import blake2b
from importlib.resources import files

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM = 3
WINDOW = 2
BAND = 8
MIN_COVERAGE = 0.8

# Notices of public licenses, in their usual words.
_NOTICES: dict[str, str] = {
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (header)": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause (conditions)": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "BSD (notice)": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0 (notice)": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 (notice)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (long notice)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 (long notice)": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "GPL-2.0 (notice)": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later (header)": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC (grant)": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT (notice)": "Released under the MIT License.",
    "MIT (grant)": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0 (notice)": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}

_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
    "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU_HEADER = (
    "{what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published "
    "by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. {what} is distributed in "
    "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
    "PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."
)
_GNU = {"GPL": ("", "This program", ("2", "3")), "LGPL": ("Lesser ", "This library", ("2.1", "3")), "AGPL": ("Affero ", "This program", ("3",))}
_CC = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}


def _templates() -> dict[str, str]:
    """The notices, the same for the other members of their families, and whole licenses."""
    out = dict(_NOTICES)
    for name, (kind, what, versions) in _GNU.items():
        for version in versions:
            number = version if "." in version else f"{version}.0"
            out.setdefault(f"{name}-{number} (notice)", f"This work is licensed under the GNU {kind}General Public License, version {version}.")
            out[f"{name}-{number}-or-later (notice)"] = f"This work is licensed under the GNU {kind}General Public License, version {version} or any later version."
            out[f"{name}-{number}-or-later (header)"] = _GNU_HEADER.format(what=what, kind=kind, version=version)
    for name, words in _CC.items():
        out.setdefault(f"CC-{name}-4.0 (notice)", f"Licensed under CC {name} 4.0.")
        out.setdefault(f"CC-{name}-4.0 (long notice)", f"This work is licensed under a Creative Commons {words} 4.0 International License.")
        out[f"CC-{name}-3.0 (notice)"] = f"Licensed under CC {name} 3.0."
        out[f"CC-{name}-3.0 (long notice)"] = f"This work is licensed under a Creative Commons {words.replace('NoDerivatives', 'NoDerivs')} 3.0 Unported License."
    two = out["BSD-2-Clause (conditions)"]
    out["BSD-2-Clause"] = f"{two} {_AS_IS}"
    out["BSD-3-Clause (conditions)"] = f"{two} 3. {_ENDORSE}"
    out["BSD-3-Clause"] = f"{two} 3. {_ENDORSE} {_AS_IS}"
    advertising = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by"
    out["BSD-4-Clause"] = f"{two} {advertising} 4. {_ENDORSE} {_AS_IS}"
    out["ISC"] = out["ISC (grant)"] + (
        ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
        "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    )
    out["MIT"] = out["MIT (grant)"] + (
        ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
        "USE OR OTHER DEALINGS IN THE SOFTWARE."
    )
    out["Unlicense"] = (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    )
    for name in ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"):
        out[name] = files("anamnesis.llm").joinpath("license_texts", f"{name}.txt").read_text("utf-8")
    return out


TEMPLATES = _templates()

#: What tells licenses of like words apart: kinds and versions, which a match must share with its template, and
#: names, which it must not lack.
_KIND = re.compile(
    r"\b(?:(?P<lesser>lesser|library)(?=\W+(?:gnu\W+)?general)|(?P<affero>affero)|(?P<nc>nc|non-?commercial)|(?P<nd>nd|no-?deriv\w*)|(?P<sa>sa|share-?alike)"
    r"|(?P<endorse>endorse)|(?P<advertising>advertising)|(?P<remotely>remotely)|(?P<later>any\W+later\W+version|or\W+later))\b"
)
_VERSION = re.compile(r"\b(?:version|v|by|nc|nd|sa|attribution|non-?commercial|no-?deriv\w*|share-?alike)[\W_]+([0-9]+(?:\.[0-9]+)*)")
_NAME = re.compile(r"\b(mit|bsd|apache|mozilla|gnu|cc|creative\W+commons)\b")
_REST_OF_VERSION = re.compile(r"(?:\.[0-9]+)+|(?:-(?:NC|ND|SA)\b)+", re.I)
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]+)", re.I)
_SPDX_ID = re.compile(r"(\bwith\s+)?(?<![\w.+-])((?!(?:and|or|with|none|noassertion)\b)[A-Za-z][A-Za-z0-9.-]*[A-Za-z0-9]\+?)", re.I)

_WORD = re.compile(r"[^\W_]+")
MATCHES = T.ArrayType(
    T.StructType(
        [
            T.StructField("license", T.StringType()),
            T.StructField("coverage", T.DoubleType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in _WORD.findall(text)]


def winnow(hashes: list[int], window: int = WINDOW) -> set[int]:
    """Places of the least hash of every window; the last of equal ones."""
    if len(hashes) <= window:
        return {min(range(len(hashes)), key=lambda i: (hashes[i], -i))} if hashes else set()
    return {min(range(at, at + window), key=lambda i: (hashes[i], -i)) for at in range(len(hashes) - window + 1)}


class Index:
    """Fingerprints of the templates -> (template, place)."""

    def __init__(self, templates: Mapping[str, str]):
        self.names = sorted(templates)
        self.words = [words_of(templates[name]) for name in self.names]
        self.marks = [marks(templates[name]) for name in self.names]
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for words in self.words for w in words}))}
        self.numbers = [np.array([self.number[w] for w in words], dtype=np.int64) for words in self.words]
        self.base = len(self.number) + 1
        self.places: dict[int, list[tuple[int, int]]] = {}
        for template, numbers in enumerate(self.numbers):
            grams = self.grams(numbers).tolist()
            mixed = [int.from_bytes(blake2b(str(g).encode(), digest_size=8).digest(), "big") for g in grams]
            for place in winnow(mixed):
                self.places.setdefault(grams[place], []).append((template, place))
        self.known = np.array(sorted(self.places), dtype=np.int64)

    def grams(self, numbers: np.ndarray) -> np.ndarray:
        """A number for every GRAM words in a row; -1 where one of them is in no template."""
        n = max(len(numbers) - GRAM + 1, 0)
        total, whole = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for at in range(GRAM):
            part = numbers[at : at + n]
            total = total * self.base + part
            whole &= part > 0
        return np.where(whole, total, -1)


def marks(text: str) -> tuple[set[str], set[str]]:
    """(kinds and versions, names) of licenses in a text."""
    low = text.lower()
    versions = {re.sub(r"(?:\.0)+$", "", m[1]) for m in _VERSION.finditer(low)}
    return {m.lastgroup for m in _KIND.finditer(low)} | versions, {m[1] for m in _NAME.finditer(low)}


def spdx(text: str) -> list[tuple[str, float, int, int]]:
    """The license ids of SPDX lines, as matches."""
    out = []
    for line in _SPDX.finditer(text):
        expression = re.split(r"\*/|-->", line[1])[0]
        # a bare id ends the expression where no operator follows it
        at = 0
        while (m := _SPDX_ID.search(expression, at)) and (at == 0 or re.search(r"\b(and|or|with)\b", expression[at : m.start(2)], re.I)):
            if not m[1]:
                out.append((f"{m[2]} (SPDX)", 1.0, line.start(1) + m.start(2), line.start(1) + m.end(2)))
            at = m.end()
    return out


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(matching words, first and last text word of the matches) of the best alignment with the whole template.

    Word i of the template may meet words low + i - BAND to high + i + BAND of the text.  Words are numbers, 0 is for
    those that match nothing.
    """
    start, width, one = low - BAND, high - low + 2 * BAND + 1, 1 << 32
    far, b = np.int64(1 << 60), np.arange(width, dtype=np.int64)
    words = np.zeros(len(template) + width, dtype=np.int64)
    words[max(0, -start) : max(0, len(text) - start)] = text[max(0, start) : max(0, start + len(words))]
    # cell: cost * one - matches; row 0 starts anywhere in the band for free
    row = np.where((start + b >= 0) & (start + b <= len(text)), 0, far)
    first, last = np.full(width, -1, dtype=np.int64), np.full(width, -1, dtype=np.int64)
    for i, word in enumerate(template):
        at = start + i + b  # the text word that is taken, so the cell stands after it
        inside, same = (at >= 0) & (at < len(text)), words[i : i + width] == word
        new = np.where(inside, row + np.where(same, -1, one), far)
        begin, end = np.where(same & (first < 0), at, first), np.where(same, at, last)
        left_out = row[1:] + one
        better = np.append(left_out < new[:-1], False)
        new[:-1] = np.minimum(new[:-1], left_out)
        begin[better], end[better] = first[1:][better[:-1]], last[1:][better[:-1]]
        # words of the text that are put in: the best cell before, and one for each step from it
        level = new - b * one
        best = np.minimum.accumulate(level)
        source = np.where(inside, np.maximum.accumulate(np.where(level == best, b, 0)), b)
        row, first, last = np.where(inside, best + b * one, new), begin[source], end[source]
    at = int(np.argmin(row))
    return int(-row[at] % one), int(first[at]), int(last[at])


def chains(hits: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """(diagonal, text word) hits cut where neighbouring diagonals are more than half a band apart."""
    out: list[list[tuple[int, int]]] = []
    for hit in sorted(hits):
        if out and hit[0] - out[-1][-1][0] <= BAND // 2:
            out[-1].append(hit)
        else:
            out.append([hit])
    return out


def _candidates(template: np.ndarray, numbers: np.ndarray, hits: list[tuple[int, int]], min_coverage: float) -> Iterator[tuple[int, int, int]]:
    """Alignments of a template that cover enough of it, of every chain of its hits."""
    least, counts = min_coverage * len(template), Counter(template.tolist())
    waiting = chains(hits)
    while waiting:
        chain = waiting.pop()
        low, high = chain[0][0], chain[-1][0]
        # no alignment matches more words than the two have in common
        near = Counter(numbers[max(0, low - BAND) : max(0, high + BAND + len(template))].tolist())
        if sum(min(n, near[word]) for word, n in counts.items()) < least:
            continue
        matches, first, last = align(template, numbers, low, high)
        if matches < least:
            continue
        yield matches, first, last
        numbers = numbers.copy()
        numbers[first : last + 1] = 0
        waiting += chains([hit for hit in chain if not first <= hit[1] <= last])


def find(index: Index, text: str, min_coverage: float = MIN_COVERAGE) -> list[tuple[str, float, int, int]]:
    """(template, coverage, start, end) of the matches in a text, in its order; start and end are characters."""
    ids = spdx(text) if index.names and "spdx" in text.lower() else []
    words = words_of(text)
    number = index.number
    numbers = np.fromiter((number.get(w, 0) for w in words), dtype=np.int64, count=len(words))
    grams = index.grams(numbers)
    known = np.flatnonzero(grams >= 0) if len(index.known) else np.empty(0, dtype=np.int64)
    hits = known[index.known[np.minimum(np.searchsorted(index.known, grams[known]), len(index.known) - 1)] == grams[known]]
    if not len(hits):
        return ids
    diagonals: dict[int, list[tuple[int, int]]] = {}
    for hit in hits.tolist():
        for template, place in index.places[int(grams[hit])]:
            diagonals.setdefault(template, []).append((hit - place, hit))
    spans = [m.span() for m in _WORD.finditer(text)]
    found = []
    for template, at in diagonals.items():
        for matches, first, last in _candidates(index.numbers[template], numbers, at, min_coverage):
            end = spans[last][1]
            more = _REST_OF_VERSION.match(text, end)
            kinds, names = marks(text[spans[first][0] : more.end() if more else end])
            if kinds == index.marks[template][0] and names >= index.marks[template][1]:
                found.append((matches, matches / len(index.words[template]), first, last, index.names[template]))
    taken: list[tuple] = []
    for match in sorted(found, key=lambda m: (-m[0], -m[1], m[2], m[4])):
        if not any(match[2] <= other[3] and other[2] <= match[3] for other in taken):
            taken.append(match)
    matched = [(name, coverage, spans[first][0], spans[last][1]) for _, coverage, first, last, name in taken]
    return sorted(matched + ids, key=lambda m: m[2])


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE, out: str = "licenses") -> DataFrame:
    """``docs`` with the array of matches (license, coverage, start, end) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates))

    @F.pandas_udf(MATCHES)
    def matches(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("license", "coverage", "start", "end"), m)) for m in find(shared.value, text or "", min_coverage)] for text in texts])

    return docs.withColumn(out, matches("text"))


def license_report(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, n_licenses and licenses of every row."""
    return scan(docs.select("doc_id", "text"), templates, min_coverage).select("doc_id", F.size("licenses").cast("bigint").alias("n_licenses"), "licenses")
