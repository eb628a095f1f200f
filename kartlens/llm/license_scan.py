"""Licence scans by patience alignment.

A text is aligned with each licence template: words that occur once in both
are anchors, the longest increasing subsequence of their positions is kept,
and the gaps between kept anchors are aligned in the same way. The share of
template words that got aligned is the coverage, if they lie within twice the
template's length. If a notice is repeated, its
words aren't unique in the text; so the alignment is also tried in every
window of up to twice the template's length that can reach the threshold: its
first word is one of the template's first, its last one of the template's
last, and their longest common subsequence (bit-parallel) is long enough.

One pass over the documents, no shuffle; a template is aligned only if
enough of its words occur in the text for the threshold to be reachable.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from kartlens.llm.common import map_batches, texts, words_alnum

# Licence notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-2": "licensed under the GNU General Public License, version 2",
    "gpl-3": "licensed under the GNU General Public License, version 3",
    "lgpl-3": "licensed under the GNU Lesser General Public License, version 3",
    "mit": "Released under the MIT License",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        'written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS '
        "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR "
        "A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
        "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "gpl-3-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "mpl-2.0": "subject to the terms of the Mozilla Public License, v. 2.0",
}
# Identifiers of SPDX lines.
SPDX = ("0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only",
        "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "MIT", "MPL-2.0",
        "Unlicense", "Zlib")
TEMPLATES |= {f"spdx-{name.lower()}": f"SPDX-License-Identifier: {name}" for name in SPDX}
THRESHOLD = 0.9


def longest_increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence (patience sort)."""
    tops: list[int] = []
    top_index: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            top_index.append(i)
        else:
            tops[pile], top_index[pile] = v, i
        back.append(top_index[pile - 1] if pile else -1)
    out, i = [], top_index[-1] if top_index else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Aligned (text, template) positions, increasing in both."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d:
            continue
        wanted = Counter(template[c:d])
        seen: dict = {}
        for i in range(a, b):
            if wanted[text[i]] == 1:
                seen[text[i]] = -1 if text[i] in seen else i
        anchors = [(seen[w], j) for j, w in enumerate(template[c:d], c) if seen.get(w, -1) >= 0]
        kept = [anchors[k] for k in longest_increasing([i for i, _ in anchors])]
        if not kept:
            # No unique word: equal words at the ends still align.
            while a < b and c < d and text[a] == template[c]:
                pairs.append((a, c))
                a, c = a + 1, c + 1
            while a < b and c < d and text[b - 1] == template[d - 1]:
                b, d = b - 1, d - 1
                pairs.append((b, d))
            continue
        pairs += kept
        before = (a - 1, c - 1)
        for i, j in [*kept, (b, d)]:
            todo.append((before[0] + 1, i, before[1] + 1, j))
            before = (i, j)
    return sorted(pairs)


def windows(text: list, template: list, least: int) -> Iterator[tuple[int, int]]:
    """All (start, end) of at most twice the template's length that begin and
    end with a word which ``least`` aligned words can begin and end with, and
    share a common subsequence of ``least`` words with the template.

    The subsequence is counted in the bits of one number, a step for each
    template word of the text."""
    size = len(template)
    at: dict = {}
    for j, w in enumerate(template):
        at[w] = at.get(w, 0) | 1 << j
    every = (1 << size) - 1
    head, tail = (1 << (size - least + 1)) - 1, every ^ ((1 << (least - 1)) - 1)
    places = [(i, at[w]) for i, w in enumerate(text) if w in at]
    for k, (start, mask) in enumerate(places):
        if not mask & head or k + least > len(places) or places[k + least - 1][0] - start >= 2 * size:
            continue
        free = every
        for m in range(k, len(places)):
            i, mask = places[m]
            if i - start >= 2 * size:
                break
            met = free & mask
            free = ((free + met) | (free - met)) & every
            if mask & tail and size - free.bit_count() >= least:
                yield start, i + 1


def coverage(text: list, template: list, threshold: float = THRESHOLD) -> tuple[float, int, int]:
    """(share of the template aligned, first and last aligned text position)
    of the best alignment of the whole text, or of a window that can reach
    ``threshold``; (0, -1, -1) without any. Aligned words that spread over
    more than twice the template's length are no notice."""
    size = len(template)
    best = (0.0, -1, -1)
    least = max(1, next((n for n in range(size + 1) if n / size >= threshold), size + 1))
    for a, b in chain([(0, len(text))], windows(text, template, least) if least <= size else ()):
        found = align(text[a:b], template)
        if found and found[-1][0] - found[0][0] < 2 * size and len(found) / size > best[0]:
            best = (len(found) / size, a + found[0][0], a + found[-1][0])
            if len(found) == size:
                break
    return best


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, coverage, first_word, last_word, licenses) for every
    row: the template with the highest coverage from ``threshold`` on (of
    equal ones the longer, then by name), where it stands in words, and all
    that reach the threshold, sorted by name.

    Without any, null, 0, null, null and an empty list: also for null, empty
    and wordless texts. Repeated rows are scanned each; other columns aren't
    read; very long texts are scanned whole."""
    compiled = {n: words_alnum(t.encode()) for n, t in (templates or TEMPLATES).items()}

    def one(text: bytes) -> tuple:
        words = words_alnum(text)
        present = set(words)
        hits = []
        for name, template in compiled.items():
            if sum(w in present for w in template) >= threshold * len(template):
                share, first, last = coverage(words, template, threshold)
                if share >= threshold:
                    hits.append((-share, -len(template), name, first, last))
        hits.sort()
        if not hits:
            return None, 0.0, None, None, []
        share, _, name, first, last = hits[0]
        return name, -share, first, last, sorted(h[2] for h in hits)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [one(t) for t in texts(batch)]
        kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *columns], ["doc_id", "license", "coverage", "first_word", "last_word", "licenses"]
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, license string, coverage double, first_word long, last_word long, licenses array<string>"
    return map_batches(docs.select("doc_id", "text"), run, schema)
