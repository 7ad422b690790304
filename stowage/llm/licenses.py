"""License scans: winnowed template fingerprints, then banded alignment.

Templates are cut into K-word grams, of which winnowing keeps the least of
each WINDOW in a row; an inverted index holds where each kept gram stands. A
text's grams are looked up there: any K + WINDOW - 1 words in a row that it
shares with a template are met. Where hits of a template gather, its words
are aligned with the text's inside a band around the hits' diagonal, which
gives the share of the template that is matched and the matched span. The
index is as large as the templates, whatever the number of documents. Places
that hold too few of a template's words to reach the coverage in any order are
not aligned.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import lowered, text_slices

K, WINDOW = 3, 2
#: Least share of a template's words that are matched in order.
COVERAGE = 0.8
#: Fingerprints that an index may hold; more are refused (about 100 bytes each).
INDEX = 1_000_000
#: Whole texts of long licenses: a folder that many systems have.
TEXTS = "/usr/share/common-licenses"
# A cell of an alignment is one number: matched words, the first place, and the last counted from the end.
_FIRST, _MATCHED = 1 << 21, 1 << 42
_PLACES = _FIRST - 1
_WORD = re.compile(r"\w+(?:[.\-+]\w+)*")

# Whole short licenses by name, and the notices by which files claim long ones.
_WARRANTY = {
    "MIT": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
}
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _WARRANTY["MIT"],
    "BSD-2-Clause": _BSD_2 + _WARRANTY["BSD"],
    "BSD-3-Clause": _BSD_2 + _BSD_3 + _WARRANTY["BSD"],
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _WARRANTY["ISC"],
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _WARRANTY["ISC"],
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-or-later": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
}


def words(text: str) -> list[str]:
    return _WORD.findall(lowered(text))


def winnow(tokens: list[str]) -> list[int]:
    """Places of the grams that winnowing keeps: the rightmost least hash of each window."""
    hashes = [xxhash.xxh64_intdigest(" ".join(tokens[i : i + K])) for i in range(len(tokens) - K + 1)]
    kept = []
    for i in range(max(1, len(hashes) - WINDOW + 1)) if hashes else ():
        best = min(range(i, min(i + WINDOW, len(hashes))), key=lambda j: (hashes[j], -j))
        if best not in kept[-1:]:
            kept.append(best)
    return kept


def align(template: Sequence, text: Sequence, shift: int, band: int) -> tuple[int, int, int]:
    """Longest common run of words in order, with template word i near text word i + shift (at most `band` apart).

    Returns the number of matched words and the first and last matched place in
    the text; of equally long runs that which begins last, then that which ends
    first. A text may end before the template does.
    """
    template, text = np.asarray(template), np.asarray(text)
    best, at = np.zeros(len(text) + 1, np.int64), np.arange(len(text))  # best[j + 1]: in the text up to word j
    begins, ends = at * _FIRST, _PLACES - at
    for i, word in enumerate(template):
        lo, hi = max(0, i + shift - band), min(len(text), i + shift + band + 1)
        if lo < hi:
            before, above = best[lo:hi], best[lo + 1 : hi + 1]
            begun = np.where(before > 0, before & (_PLACES * _FIRST), begins[lo:hi])
            longer = (before & -_MATCHED) + _MATCHED + begun + ends[lo:hi]
            best[lo + 1 : hi + 1] = np.maximum.accumulate(np.where(text[lo:hi] == word, np.maximum(longer, above), above))
    top = int(best.max())
    return (top // _MATCHED, top // _FIRST & _PLACES, _PLACES - (top & _PLACES)) if top else (0, -1, -1)


def texts_in(folder: str) -> dict[str, str]:
    """Whole license texts by name (`GPL-3-text` of a file GPL-3): the files of a folder that the driver sees, without links; none if there is no such folder."""
    held = sorted(p for p in Path(folder).iterdir() if p.is_file() and not p.is_symlink()) if Path(folder).is_dir() else []
    return {f"{p.name}-text": p.read_text(encoding="utf-8", errors="replace") for p in held}


class Scanner:
    """Matches of one text. templates: license name to text."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.templates = {name: words(t) for name, t in sorted(templates.items())}
        self.coverage, self.index = coverage, {}
        for name, tokens in self.templates.items():
            for i in winnow(tokens):
                self.index.setdefault(tuple(tokens[i : i + K]), []).append((name, i))
        if sum(map(len, self.index.values())) > INDEX:
            raise ValueError(f"the templates have more than {INDEX} fingerprints")
        self.ids = {w: i for i, w in enumerate(sorted({w for t in self.templates.values() for w in t}), 1)}
        self.coded = {name: np.array([self.ids[w] for w in t], np.int64) for name, t in self.templates.items()}
        self.bags = {name: np.bincount(t, minlength=len(self.ids) + 1) for name, t in self.coded.items()}

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """license, coverage, start, end (characters of the text), without overlaps: the longest match first."""
        low = lowered(text or "")
        tokens, index = _WORD.findall(low), self.index
        hits = [i for i, g in enumerate(zip(tokens, tokens[1:], tokens[2:])) if g in index]
        if not hits:
            return []
        near: dict[str, list[tuple[int, int]]] = {}
        for i in hits:
            for name, at in index[tuple(tokens[i : i + K])]:
                near.setdefault(name, []).append((i - at, i))
        found, coded = [], np.array([self.ids.get(w, 0) for w in tokens], np.int64)
        for name, pairs in near.items():
            template, bag = self.coded[name], self.bags[name]
            if len(tokens) < self.coverage * len(template):
                continue
            band = 2 + len(template) // 20
            pairs.sort()
            last = None
            for shift, _ in pairs:
                if last is not None and shift - last <= band:
                    continue  # the same place, met again
                last = shift
                around = coded[max(0, shift - band) : shift + len(template) + band]
                if np.minimum(np.bincount(around, minlength=len(bag)), bag)[1:].sum() < self.coverage * len(template):
                    continue  # too few of its words, in whatever order
                n, a, z = align(template, around, min(shift, band), band)
                if n >= self.coverage * len(template):
                    found.append((n, n / len(template), a + max(0, shift - band), z + max(0, shift - band), name))
        taken, out = [], []  # taken: places in order, apart from one another
        for n, share, a, z, name in sorted(found, key=lambda m: (-m[0], -m[1], m[2], m[4])):
            at = bisect(taken, (a, z))
            if (not at or taken[at - 1][1] < a) and (at == len(taken) or z < taken[at][0]):
                taken.insert(at, (a, z))
                out.append((name, share, a, z))
        if not out:
            return []
        places = [m.span() for m in _WORD.finditer(low)]
        return sorted(((name, share, places[a][0], places[z][1]) for name, share, a, z in out), key=lambda m: m[2])


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, start, end: one row for each match in each row's whole text.

    Null and empty texts have none. Of overlapping matches the one with most
    matched words is given (ties: the greater coverage, the earlier, the first
    name). Repeated rows give their matches again; other columns are ignored;
    no rows give no rows.
    """
    Scanner(templates, coverage)  # refuses an index that is too large before any task starts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for b in text_slices(batches):
            rows = [(i, *m) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for m in scanner.scan(t)]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "license", "coverage", "start", "end"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, license string, coverage double, start int, end int")


def op10_license_scans(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), TEMPLATES | texts_in(TEXTS))
