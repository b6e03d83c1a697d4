"""Operator 7, license scans: patience alignment of texts with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowfeat.llm._spark import table
from flowfeat.llm._text import slices, words

COVERAGE, LINE_WORDS = 0.8, 12

WORD = re.compile(r"[^\W_]+")  # what isalnum() calls a letter or digit

# Public license notices and texts. Those of LINE_WORDS words at most count only as a whole and without gaps.
BSD_TWO_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
    conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
    disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
    disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD_CLAUSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
    derived from this software without specific prior written permission."""
BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
    BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
    COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
    BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
    AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
    OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
ISC_NOTICE = """provided that the above copyright notice and this permission notice appear in all copies."""
ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
    WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
    DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
    TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
    (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
    publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
    subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
    substantial portions of the Software."""
MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
    MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
    CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
    SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
GPL_NOTICE = """is free software: you can redistribute it and/or modify it under the terms of the GNU {name} License as published by the Free
    Software Foundation, either version {version} of the License, or (at your option) any later version. This {kind} is distributed in the
    hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
    PURPOSE. See the GNU {name} License for more details."""
TEMPLATES = {
    "0BSD": f"{ISC_GRANT}. {ISC_WARRANTY}",
    "AGPL-3.0 line": "GNU Affero General Public License, version 3",
    "AGPL-3.0 notice": "This program " + GPL_NOTICE.format(name="Affero General Public", version=3, kind="program"),
    "Apache-2.0 line": "under the Apache License, Version 2.0",
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
        ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": f"{BSD_TWO_CLAUSES} {BSD_WARRANTY}",
    "BSD-2-Clause conditions": BSD_TWO_CLAUSES,
    "BSD-2-Clause line": "under the BSD 2-Clause License",
    "BSD-3-Clause": f"{BSD_TWO_CLAUSES} {BSD_THIRD_CLAUSE} {BSD_WARRANTY}",
    "BSD-3-Clause conditions": f"{BSD_TWO_CLAUSES} {BSD_THIRD_CLAUSE}",
    "BSD-3-Clause line": "under the BSD 3-Clause License",
    "BSL-1.0 line": "under the Boost Software License, Version 1.0",
    "CC-BY-4.0 line": "under CC BY 4.0",
    "CC-BY-NC-4.0 line": "under CC BY-NC 4.0",
    "CC-BY-NC-ND-4.0 line": "under CC BY-NC-ND 4.0",
    "CC-BY-NC-SA-4.0 line": "under CC BY-NC-SA 4.0",
    "CC-BY-ND-4.0 line": "under CC BY-ND 4.0",
    "CC-BY-SA-4.0 line": "under CC BY-SA 4.0",
    "CC0-1.0 line": "under CC0 1.0",
    "GPL-2.0 line": "GNU General Public License, version 2",
    "GPL-2.0 notice": "This program " + GPL_NOTICE.format(name="General Public", version=2, kind="program"),
    "GPL-3.0 line": "GNU General Public License, version 3",
    "GPL-3.0 notice": "This program " + GPL_NOTICE.format(name="General Public", version=3, kind="program"),
    "ISC": f"{ISC_GRANT}, {ISC_NOTICE} {ISC_WARRANTY}",
    "ISC grant": f"{ISC_GRANT}, {ISC_NOTICE}",
    "LGPL-2.1 line": "GNU Lesser General Public License, version 2.1",
    "LGPL-2.1 notice": "This library " + GPL_NOTICE.format(name="Lesser General Public", version=2.1, kind="library"),
    "LGPL-3.0 line": "GNU Lesser General Public License, version 3",
    "LGPL-3.0 notice": "This library " + GPL_NOTICE.format(name="Lesser General Public", version=3, kind="library"),
    "MIT": f"{MIT_GRANT} {MIT_WARRANTY}",
    "MIT grant": MIT_GRANT,
    "MIT line": "under the MIT License",
    "MPL-2.0 line": "under the Mozilla Public License, version 2.0",
    "MPL-2.0 notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
        and by any means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not
        be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in
        the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must
        not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}
# What tells long texts apart stands word for word in the passage, whatever its coverage.
NEEDS = {
    "0BSD": ["hereby granted"],
    "AGPL-3.0 notice": ["GNU Affero General Public License", "either version 3 of"],
    "Apache-2.0 notice": ["Apache License, Version 2.0"],
    "BSD-3-Clause": ["may be used to endorse or promote"],
    "BSD-3-Clause conditions": ["may be used to endorse or promote"],
    "GPL-2.0 notice": ["GNU General Public License", "either version 2 of"],
    "GPL-3.0 notice": ["GNU General Public License", "either version 3 of"],
    "ISC": ["copyright notice and this permission notice"],
    "ISC grant": ["copyright notice and this permission notice"],
    "LGPL-2.1 notice": ["GNU Lesser General Public License", "either version 2.1 of"],
    "LGPL-3.0 notice": ["GNU Lesser General Public License", "either version 3 of"],
    "MIT": ["deal in the Software without restriction"],
    "MIT grant": ["deal in the Software without restriction"],
    "MPL-2.0 notice": ["Mozilla Public License", "2.0"],
    "Unlicense": ["public domain"],
}


class Template(NamedTuple):
    name: str
    words: list[int]
    needs: list[list[int]]
    whole: bool  # counts only without gaps
    number: bool  # ends with a number, which must not go on in the text

    @staticmethod
    def of(texts: dict[str, str], needs: dict[str, list[str]]) -> list[Template]:
        lists = {k: hashes(v) for k, v in sorted(texts.items())}
        return [Template(k, v, [hashes(x) for x in needs.get(k, [])], len(v) <= LINE_WORDS, texts[k].rstrip()[-1:].isdigit()) for k, v in lists.items() if v]


def hashes(text: str) -> list[int]:
    return words([text])[0].tolist()


def anchors(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Places of words that are unique in both ranges, as the longest increasing subsequence of them."""
    once = {w for w, n in Counter(a[a0:a1]).items() if n == 1} & {w for w, n in Counter(b[b0:b1]).items() if n == 1}
    there = {b[j]: j for j in range(b0, b1) if b[j] in once}
    piles: list[int] = []  # last place in b of each pile
    tops: list[tuple[int, int, int]] = []  # (place in a, place in b, the pair before)
    last: list[int] = []
    for i in range(a0, a1):
        if (j := there.get(a[i])) is None:
            continue
        k = bisect_left(piles, j)
        tops.append((i, j, last[k - 1] if k else -1))
        piles[k : k + 1] = [j]
        last[k : k + 1] = [len(tops) - 1]
    out, at = [], last[-1] if last else -1
    while at >= 0:
        i, j, at = tops[at]
        out.append((i, j))
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of a and b: equal words at both ends of a range, else anchors, and then the gaps between them."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        found = anchors(a, b, a0, a1, b0, b1)
        if not found:
            continue
        out += found
        edges = [(a0 - 1, b0 - 1), *found, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if k > i + 1 and m > j + 1]
    return sorted(out)


def holds(region: list[int], phrase: list[int]) -> bool:
    return any(region[i : i + len(phrase)] == phrase for i in range(len(region) - len(phrase) + 1))


def goes_on(text: str, nth: int) -> bool:
    """Whether the number that is the text's nth word goes on behind a full stop, as in 2.1."""
    for k, m in enumerate(WORD.finditer(text)):
        if k == nth:
            return re.match(r"\.\d", text[m.end() : m.end() + 2]) is not None
    return False


def scan(texts: list[str | None], templates: list[Template], coverage: float) -> list[list[tuple[str, float, int, int, int]]]:
    """Per text the (license, coverage, first word, end, words found) of every template that it covers well enough, in its best window.

    Windows of twice a template's length start every half of it, so any passage of up to one and a half lengths lies in one whole.
    Only windows with enough words of the template are aligned, which leaves none out: aligned words are words of the template.
    A template that counts without gaps only is aligned with as many words, from each place of its first word on.
    """
    h, off = words(texts)
    out: list[list[tuple[str, float, int, int, int]]] = [[] for _ in texts]
    if not len(h) or not templates:
        return out
    every = np.unique(np.concatenate([np.array(t.words, np.uint64) for t in templates]))
    at = np.minimum(np.searchsorted(every, h), len(every) - 1)
    some = np.flatnonzero(every[at] == h)  # most words are in no template
    kind = at[some]
    for t in templates:
        length = len(t.words)
        size, step, need = (length, 1, length) if t.whole else (2 * length, max(1, length // 2), int(np.ceil(coverage * length)))
        here = some[np.isin(every, np.array(t.words, np.uint64))[kind]]
        if t.whole:
            starts = some[kind == np.searchsorted(every, np.uint64(t.words[0]))]
        else:
            # windows with enough words: counted at the words, since a window without them can't have any
            first = off[:-1][np.searchsorted(off, here, "right") - 1]
            starts = np.unique(np.concatenate([first + np.maximum(0, (here - first) // step - k) * step for k in range(-(-size // step))])) if len(here) else np.zeros(0, np.int64)
        of = np.searchsorted(off, starts, "right") - 1
        stops = np.minimum(starts + size, off[1:][of])
        ok = np.searchsorted(here, stops) - np.searchsorted(here, starts) >= need
        best: dict[int, tuple[int, int, int]] = {}
        for s, e, i in zip(starts[ok].tolist(), stops[ok].tolist(), of[ok].tolist()):
            if best.get(i, (0,))[0] == length:
                continue
            region = h[s:e].tolist()
            pairs = patience(t.words, region)
            if len(pairs) < need or len(pairs) <= best.get(i, (0,))[0]:
                continue
            lo, hi = pairs[0][1], pairs[-1][1] + 1
            if all(holds(region[lo:hi], x) for x in t.needs) and not (t.number and goes_on(texts[i], s + hi - 1 - int(off[i]))):
                best[i] = (len(pairs), s + lo - int(off[i]), s + hi - int(off[i]))
        for i, (n, lo, hi) in best.items():
            out[i].append((t.name, n / length, lo, hi, n))
    return out


def apart(found: list[tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int, int]]:
    """Licenses in the given order without those that lie across an earlier one."""
    out: list[tuple[str, float, int, int, int]] = []
    for m in found:
        if all(m[3] <= x[2] or m[2] >= x[3] for x in out):
            out.append(m)
    return out


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, needs: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Per row of docs: the id, ``license`` (the best one or null), its ``coverage``, ``first_word``, ``end_word`` and ``licenses`` (names, sorted).

    Coverage is the share of a template's words that patience alignment finds in the text in order. Templates of ``LINE_WORDS`` words at most
    are found without gaps or not at all, and a number at their end must end in the text too; of longer ones ``coverage`` is enough,
    if the phrases that ``needs`` gives for them stand in the passage. The best license has
    the most words found, then the highest coverage, then the first name; of licenses that overlap in the text the better one is named. Words are
    compared in lower case without punctuation, over whole texts. Null texts and texts without words have no license; templates without
    words are void; repeated rows give repeated rows. Rows are scanned where they lie, without a shuffle.
    """
    given, wanted = (TEMPLATES, NEEDS) if templates is None else (templates, needs or {})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Template.of(given, wanted)
        for b in batches:
            texts = b.column("text").to_pylist()
            found = [x for i, j in slices(texts) for x in scan(texts[i:j], made, coverage)]
            found = [apart(sorted(x, key=lambda m: (-m[4], -m[1], m[0]))) for x in found]
            best = [x[0] if x else (None,) * 5 for x in found]
            cols = list(zip(*best)) if best else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array([sorted(m[0] for m in x) for x in found], pa.list_(pa.string()))],
                names=[id_col, "license", "coverage", "first_word", "end_word", "licenses"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(find, f"`{id_col}` {kind}, license string, coverage double, first_word long, end_word long, licenses array<string>")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
