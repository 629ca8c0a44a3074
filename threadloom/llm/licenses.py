"""License scans: Dice coefficient over word bigrams against licence templates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcode as tc

#: Least Dice coefficient of a passage and a template.
THRESHOLD = 0.7

#: (licence, wording); a licence may have several wordings.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0"),
)

_BSD_TAIL = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
#: Wordings of whole notices and licences, for passages within a text.
FULL_TEMPLATES = (
    *TEMPLATES,
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    (
        "BSD-3-Clause",
        _BSD_HEAD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission." + _BSD_TAIL,
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
        "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
        "not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "MIT",
        TEMPLATES[2][1] + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "GPL-3.0",
        TEMPLATES[6][1] + " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the "
        "GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "Apache-2.0",
        TEMPLATES[4][1] + " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "ISC",
        TEMPLATES[11][1] + ", provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE "
        "AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
        "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
        "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)


class Matcher:
    """Bigram sets of the templates, ordered by size so that size bounds are a range."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        w = tc.Words(pa.array([t for _, t in templates], pa.string()))
        grams, off = tc.distinct(*tc.ngrams(w.hash, w.off, 2))
        sets = [(grams[a:b], name) for (name, _), a, b in zip(templates, off[:-1], off[1:]) if b > a]
        sets.sort(key=lambda s: len(s[0]))
        self.sets, self.threshold = sets, threshold
        self.sizes = np.array([len(s) for s, _ in sets])
        self.all = np.unique(np.concatenate([s for s, _ in sets]))

    def passages(self, column: pa.Array) -> dict[int, dict[str, float]]:
        """For each passage with a match, the best coefficient of each licence."""
        w = tc.Words(column)
        grams, off = tc.distinct(*tc.ngrams(w.hash, w.off, 2))
        known = self.all[np.minimum(np.searchsorted(self.all, grams), len(self.all) - 1)] == grams
        total = np.concatenate([[0], np.cumsum(known)])
        shared, size = total[off[1:]] - total[off[:-1]], np.diff(off)
        # sets of sizes a and b reach the threshold t only if 2 min(a, b) >= t (a + b)
        t = self.threshold
        low, high = size * t / (2 - t) - 1e-9, size * (2 - t) / t + 1e-9
        first, last = np.searchsorted(self.sizes, low, side="left"), np.searchsorted(self.sizes, high, side="right")
        possible = (last > first) & (size > 0)
        least = self.sizes[np.minimum(first, len(self.sizes) - 1)]
        possible &= 2 * shared >= t * (size + least) - 1e-9
        out: dict[int, dict[str, float]] = {}
        for i in np.flatnonzero(possible).tolist():
            own = grams[off[i] : off[i + 1]]
            for s, name in self.sets[first[i] : last[i]]:
                dice = 2 * np.isin(own, s, assume_unique=True).sum() / (len(own) + len(s))
                if dice >= t - 1e-12:
                    best = out.setdefault(i, {})
                    best[name] = max(best.get(name, 0.0), float(dice))
        return out

    def windows(self, column: pa.Array) -> dict[int, dict[str, list[float]]]:
        """For each text, the coefficients of each licence's windows, the best ones without overlap.

        A window is any run of words.  A best one begins and ends with a bigram of the
        template, and its first bigram doesn't recur in it, else a shorter one is as good.
        """
        w = tc.Words(column)
        grams, off = tc.ngrams(w.hash, w.off, 2)
        hits = np.flatnonzero(self.all[np.minimum(np.searchsorted(self.all, grams), len(self.all) - 1)] == grams)
        t = self.threshold
        found: dict[tuple[int, str], list[tuple[float, int, int]]] = {}
        for s, name in self.sets:
            at = hits[np.isin(grams[hits], s)]
            rows = np.searchsorted(off, at, side="right") - 1
            own, need, most = set(s.tolist()), len(s) * t / (2 - t) - 1e-9, len(s) * (2 - t) / t + 1e-9
            for r in np.flatnonzero(np.bincount(rows) >= need).tolist() if len(at) else ():
                here = at[rows == r]
                if len(np.unique(grams[here])) < need:
                    continue
                for i in here.tolist():
                    seen, shared, first = set(), 0, grams[i]
                    for j in range(i, int(off[r + 1])):
                        g = int(grams[j])
                        if j > i and g == first:
                            break
                        if g in seen:
                            continue
                        seen.add(g)
                        if len(seen) > most:
                            break
                        if g in own:
                            shared += 1
                            dice = 2 * shared / (len(seen) + len(own))
                            if dice >= t - 1e-12:
                                found.setdefault((r, name), []).append((dice, i, j))
        out: dict[int, dict[str, list[float]]] = {}
        for (r, name), spans in found.items():
            taken: list[tuple[float, int, int]] = []
            for x in sorted(spans, key=lambda x: (-x[0], x[1] - x[2], x[1])):
                if all(x[2] < i or x[1] > j for _, i, j in taken):
                    taken.append(x)
            out.setdefault(r, {})[name] = [dice for dice, _, _ in taken]
        return out


@lru_cache(maxsize=4)
def matcher(templates: tuple[tuple[str, str], ...], threshold: float) -> Matcher:
    return Matcher(templates, threshold)


def find(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, n_passages): licences that a passage of the document states.

    The passages of a text are its lines, its blocks (parted by blank lines) where
    it has several, and the whole.  Words are compared without case and
    punctuation.  ``dice`` is the best coefficient, ``n_passages`` counts the lines,
    blocks and whole texts that reach the threshold for the licence.  A map, without
    a shuffle.  Null and empty texts state nothing; repeated rows are reported
    again; other columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher(templates, threshold)
        for batch in batches:
            ids = batch.column(0)
            rows, names, best, count = [], [], [], []
            for a, b in tc.slices(batch.column(1)):
                part = batch.column(1).slice(a, b - a)
                per: dict[tuple[int, str], list[float]] = {}
                lines, blocks = pc.split_pattern(part, "\n"), pc.split_pattern_regex(part, r"\n[ \t\r]*\n")
                several = [i for i, n in enumerate(pc.list_value_length(blocks).to_pylist()) if n > 1]
                multi = [i for i, n in enumerate(pc.list_value_length(lines).to_pylist()) if n > 1]
                for values, owner in (
                    (lines.flatten(), pc.list_parent_indices(lines).to_numpy()),
                    (blocks.take(pa.array(several, pa.int64())).flatten(), np.array(several, np.int64)[pc.list_parent_indices(blocks.take(pa.array(several, pa.int64()))).to_numpy()]),
                    (part.take(pa.array(multi, pa.int64())), np.array(multi, np.int64)),
                ):
                    for i, found in match.passages(values).items():
                        for name, dice in found.items():
                            per.setdefault((int(owner[i]), name), []).append(dice)
                for (i, name), found in per.items():
                    rows.append(a + i)
                    names.append(name)
                    best.append(max(found))
                    count.append(len(found))
            if rows:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(names), pa.array(best), pa.array(count, pa.int32())], ["doc_id", "license", "dice", "n_passages"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, license string, dice double, n_passages int")


def find_within(docs: DataFrame, templates: tuple[tuple[str, str], ...] = FULL_TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, n_passages): licences that any run of words of the document states.

    As ``find``, but line ends, comment marks and the words around a statement don't
    matter.  ``n_passages`` counts windows that don't overlap.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher(templates, threshold)
        for batch in batches:
            for a, b in tc.slices(batch.column(1)):
                found = [(a + i, name, max(dice), len(dice)) for i, per in match.windows(batch.column(1).slice(a, b - a)).items() for name, dice in per.items()]
                if found:
                    rows, names, best, count = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(names), pa.array(best), pa.array(count, pa.int32())], ["doc_id", "license", "dice", "n_passages"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, license string, dice double, n_passages int")
