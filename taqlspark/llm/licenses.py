"""Licence scan: Dice coefficient over word bigrams between normalised text and licence templates.

A text is compared by its runs of words, wherever they begin and end, so that a notice counts within
a line as well as over several paragraphs of a long document; a template's coefficient is that of the
best run. A run of m bigrams and a template of n share at most min(m, n), so the coefficient 2 * shared
/ (m + n) can reach t only if t / (2 - t) <= m / n <= (2 - t) / t. An index from bigrams to templates
finds the places where a template's bigrams stand; the best run begins and ends at such places, and
templates and places without enough of them near by are pruned. The templates are a fixed, small list,
so each task holds them.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import batches_of

#: Coefficient from which a run is a template's text.
DICE = 0.8

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_1_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
_BSD_END = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: (licence, text): full texts or notices, and one-line notices. Fixed values.
TEMPLATES = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. " + _AS_IS,
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-2-Clause", _BSD_1_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_1_2 + _BSD_3 + _BSD_END),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "
        '"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR "
        "OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        'or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have "
        "received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

_WORD = re.compile(r"[^\W_]+")


def bigrams(text: str) -> list[tuple[str, str]]:
    """Word bigrams of the normalised text: lower case, letters and digits only; one word pairs with nothing."""
    words = _WORD.findall(text.lower())
    if len(words) == 1:
        return [(words[0], "")]
    return list(zip(words, words[1:], strict=False))


@dataclass
class Index:
    """Templates by their bigrams."""

    names: list[str]
    sizes: list[int]
    grams: dict[tuple[str, str], list[tuple[int, int]]]
    #: Templates of one word, which only a unit of that word is text of.
    single: dict[str, list[int]]

    @classmethod
    def of(cls, templates: tuple[tuple[str, str], ...]) -> "Index":
        grams: dict[tuple[str, str], list[tuple[int, int]]] = {}
        single: dict[str, list[int]] = {}
        sizes = []
        for i, (_, text) in enumerate(templates):
            own = Counter(bigrams(text))
            sizes.append(sum(own.values()))
            for g, n in own.items():
                if g[1]:
                    grams.setdefault(g, []).append((i, n))
                else:
                    single.setdefault(g[0], []).append(i)
        return cls([n for n, _ in templates], sizes, grams, single)

    def matches(self, text: str, least: float) -> list[tuple[float, int]]:
        """(coefficient, template) of the templates that a run of the text's words is text of."""
        found = [(1.0, i) for u in units(text) if len(w := _WORD.findall(u.lower())) == 1 for i in self.single.get(w[0], ())] if self.single else []
        words = _WORD.findall(text.lower())
        hits = [(p, g) for p, g in enumerate(zip(words, words[1:], strict=False)) if g in self.grams]
        shared: Counter[int] = Counter()
        for g, n in Counter(g for _, g in hits).items():
            for i, k in self.grams[g]:
                shared[i] += min(n, k)
        for i, s in shared.items():
            n = self.sizes[i]
            if 2 * s / (s + n) >= least and (best := self._best(i, hits, least)) >= least:
                found.append((best, i))
        return found

    def _best(self, i: int, hits: list[tuple[int, tuple[str, str]]], least: float) -> float:
        """The largest coefficient of template i and a run, if it is ``least`` or more; hits: places of indexed bigrams."""
        n = self.sizes[i]
        own = [(p, g, k) for p, g in hits for j, k in self.grams[g] if j == i]
        places = np.array([p for p, _, _ in own])
        ends = np.searchsorted(places, places + int(2 * n / least - n + 1e-9))
        most = np.minimum(ends - np.arange(len(own)), n)
        bounds = 2 * most / (most + n)
        best = 0.0
        for a in np.flatnonzero(bounds >= least).tolist():
            if bounds[a] <= best:
                continue
            begin, s, used = own[a][0], 0, {}
            for p, g, k in own[a : ends[a]]:
                c = used.get(g, 0)
                if c < k:
                    used[g] = c + 1
                    s += 1
                    best = max(best, 2 * s / (p - begin + 1 + n))
            if best == 1.0:
                break
        return best


_BLANK = re.compile(r"\n[ \t\r]*\n")


def units(text: str) -> Iterator[str]:
    """Lines, paragraphs of more than one line, and a whole text of more than one paragraph."""
    lines = text.split("\n")
    yield from lines
    if len(lines) > 1:
        paragraphs = _BLANK.split(text)
        yield from (p for p in paragraphs if "\n" in p.strip("\n"))
        if len(paragraphs) > 1:
            yield text


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    least: float = DICE,
) -> DataFrame:
    """(id, license, dice, licenses): one row per document, without a shuffle.

    A document matches a template if a run of its words does. license and dice are of the best match (ties: the template listed first), null without one; licenses
    has all matching licences, sorted and joined by commas, empty without one. A null or empty text
    matches nothing. Repeated rows and null ids each give a row. Other columns are not read.
    """
    if not 0 < least <= 1:
        raise ValueError("the coefficient lies above 0 and up to 1")
    batches_of(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.of(templates)
        for b in batches:
            best, dice, every = [], [], []
            for t in b.column(1).to_pylist():
                found = index.matches(t, least) if t else []
                top = min(found, key=lambda x: (-x[0], x[1]), default=None)
                best.append(index.names[top[1]] if top else None)
                dice.append(top[0] if top else None)
                every.append(",".join(sorted({index.names[i] for _, i in found})))
            yield pa.record_batch(
                [b.column(0), pa.array(best, pa.string()), pa.array(dice, pa.float64()), pa.array(every, pa.string())],
                names=["id", "license", "dice", "licenses"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(
        run, "id long, license string, dice double, licenses string"
    )
