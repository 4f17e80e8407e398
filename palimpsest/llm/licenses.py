"""License scans: Dice coefficient over word bigrams against license templates.

A unit of a text is a line, a paragraph (between blank lines) of several lines, or
the whole text; its words are lower-cased runs of letters and digits, its set the
distinct pairs of adjacent words.  A template of ``b`` bigrams can reach the
coefficient ``t`` only with units of ``b*t/(2-t)`` to ``b*(2-t)/t`` bigrams, so
templates are kept sorted by size and only that range is compared.  Texts without
any template's bigram are left after one lookup.

A license may also share its unit with other words.  So a template that no unit
reaches is looked for in the runs of words of the text (copyright lines first taken
out), and the run with the largest coefficient is one more unit.  Such a run may begin and
end with bigrams of the template, since others at the ends only lower the coefficient,
and is at most ``b*(2-t)/t`` distinct bigrams long.  Only stretches with enough of the
template's bigrams are tried.

The templates travel with the task; their number and size are a parameter of a few
kilobytes.  One pass, no shuffle, memory of one text.

Defined results.  Null, empty and wordless texts match nothing and have 0 units.
Ties go to the larger coefficient, then the name in order.  A row per input row;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, column_bytes, mix, odd_constants

THRESHOLD = 0.8
_C = odd_constants(2, 303)
_COPYRIGHT = re.compile(rb"(?im)^[^\w\n]*(?:copyright\b|\(c\)|\xc2\xa9)[^\n]{0,200}$")
_BLANK = re.compile(rb"\n[ \t\r\x0b\x0c]*\n")
_KEEP = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

#: Short statements and the opening or full text of common public licenses.
TEMPLATES: dict[str, str] = {
    "AllRightsReserved": "All rights reserved.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT-line": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.",
}

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_HOLDERS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_AUTHOR = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_NO_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
#: Whole texts without title and copyright line; the longer ones are files of ``license_texts``.
TEMPLATES |= {
    "BSD-2-Clause-text": f"{TEMPLATES['BSD-2-Clause']} {_HOLDERS}",
    "BSD-3-Clause-text": f"{TEMPLATES['BSD-2-Clause']} {_NO_NAMES} {_HOLDERS}",
    "ISC-text": f"{TEMPLATES['ISC']} {_AUTHOR}",
    "MIT-text": f"{TEMPLATES['MIT']} {_AS_IS}",
}
#: Bigrams of a template from which on its runs are tried by arrays; changes no result.
ARRAYS_FROM = 150


def license_texts() -> dict[str, str]:
    """The whole texts of longer licenses, by the name of their file."""
    return {f.stem: f.read_text() for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def bigrams(text: bytes, words: WordHashes) -> tuple[np.ndarray, int]:
    """Sorted distinct bigram hashes and the number of words."""
    h = words.array(text.translate(_KEEP).split())
    if len(h) < 2:
        return np.empty(0, np.uint64), len(h)
    return np.unique(mix(h[:-1] * _C[0] + h[1:] * _C[1])), len(h)


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.words = WordHashes()
        sets = sorted((len(s), name, s) for name, t in templates.items() for s in [bigrams(t.encode(), self.words)[0]] if len(s))
        self.names = [name for _, name, _ in sets]
        self.sets = [s for _, _, s in sets]
        self.sizes = np.array([n for n, _, _ in sets])
        self.any = np.unique(np.concatenate(self.sets)) if sets else np.empty(0, np.uint64)
        self.threshold = threshold

    def _known(self, grams: np.ndarray) -> bool:
        at = np.searchsorted(self.any, grams)
        at[at == len(self.any)] = 0
        return bool((self.any[at] == grams).any())

    def unit(self, text: bytes) -> list[tuple[float, str]]:
        """Templates that a unit reaches, with the coefficient."""
        grams, _ = bigrams(text, self.words)
        n, t = len(grams), self.threshold
        if not n or not self._known(grams):
            return []
        low = np.searchsorted(self.sizes, n * t / (2 - t) - 1e-9, side="left")
        high = np.searchsorted(self.sizes, n * (2 - t) / t + 1e-9, side="right")
        out = []
        for k in range(low, high):
            both = len(np.intersect1d(grams, self.sets[k], assume_unique=True))
            dice = 2 * both / (n + len(self.sets[k]))
            if dice >= t:
                out.append((dice, self.names[k]))
        return out

    def _enough(self, distinct: np.ndarray, known: set[str]) -> list[int]:
        """Templates outside ``known`` of which the bigrams hold as many as the threshold asks of any run."""
        at = np.searchsorted(self.any, distinct)
        at[at == len(self.any)] = 0
        distinct = distinct[self.any[at] == distinct]
        out = []
        for k, (name, grams) in enumerate(zip(self.names, self.sets)):
            need = len(grams) * self.threshold / (2 - self.threshold) - 1e-9
            if name not in known and len(distinct) >= need and len(np.intersect1d(distinct, grams, assume_unique=True)) >= need:
                out.append(k)
        return out

    def runs(self, text: bytes, grams_of_text: np.ndarray, known: set[str]) -> list[tuple[float, str]]:
        """Templates that a run of words reaches and no whole unit does, with the run's coefficient."""
        t, out = self.threshold, {}
        plain = _COPYRIGHT.sub(b" ", text)
        if plain == text and not self._enough(grams_of_text, known):
            return []
        for body in [text] if plain == text else [text, plain]:
            h = self.words.array(body.translate(_KEEP).split())
            if len(h) < 2:
                continue
            grams = mix(h[:-1] * _C[0] + h[1:] * _C[1])
            at = np.searchsorted(self.any, grams)
            at[at == len(self.any)] = 0
            where = np.flatnonzero(self.any[at] == grams)
            hits = grams[where]
            distinct = np.unique(hits)
            for k in self._enough(distinct, known):
                dice = self._best_run(grams, where[np.isin(hits, self.sets[k])], len(self.sets[k]))
                if dice >= t and dice > out.get(self.names[k], 0.0):
                    out[self.names[k]] = dice
        return [(dice, name) for name, dice in out.items()]

    def _best_run(self, grams: np.ndarray, hits: np.ndarray, m: int) -> float:
        """Largest coefficient of runs that begin and end at ``hits``, the places of a template's ``m`` bigrams."""
        most, best = m * (2 - self.threshold) / self.threshold + 1e-9, 0.0
        if m >= ARRAYS_FROM:
            return self._best_long_run(grams, hits, m, most)
        new = np.zeros(len(grams), bool)
        new[hits] = True
        for start in hits.tolist():
            seen, both, first = set(), 0, int(grams[start])
            # where the first bigram comes again, a run from there is as good
            for at in range(start, len(grams)):
                g = int(grams[at])
                if g in seen:
                    if g == first:
                        break
                    continue
                seen.add(g)
                if len(seen) > most:
                    break
                if new[at]:
                    both += 1
                    best = max(best, 2 * both / (len(seen) + m))
                    if both == m:
                        break
        return best

    def _best_long_run(self, grams: np.ndarray, hits: np.ndarray, m: int, most: float) -> float:
        """``_best_run`` by arrays: a bigram counts at its first place in the run."""
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        before, after = np.full(len(grams), -1), np.full(len(grams), len(grams))
        before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
        mine = np.zeros(len(grams), bool)
        mine[hits] = True
        best, need = 0.0, m * self.threshold / (2 - self.threshold) - 1e-9
        for k, start in enumerate(hits.tolist()):
            if len(hits) - k < need:
                break
            size, stop = 2 * int(most) + 2, int(after[start])
            while True:
                span = slice(start, min(stop, start + size))
                fresh = before[span] < start
                distinct = np.cumsum(fresh)
                if distinct[-1] > most or span.stop == stop:
                    break
                size *= 2
            end = int(np.searchsorted(distinct, most, side="right"))
            both = np.cumsum(fresh & mine[span])[:end]
            best = max(best, float((2 * both / (distinct[:end] + m)).max()))
        return best

    def text(self, text: bytes | None) -> tuple[int, int, float, str | None, str]:
        """Units, matching units, best coefficient, its template, and all templates found."""
        if not text:
            return 0, 0, 0.0, None, ""
        lines = text.split(b"\n")
        paragraphs = [p for p in _BLANK.split(text) if b"\n" in p.strip()]
        units = [x for x in [*lines, *(paragraphs if len(paragraphs) > 1 else []), *([text] if len(lines) > 1 else [])] if x.translate(_KEEP).strip()]
        grams, _ = bigrams(text, self.words)
        if not len(grams) or not len(self.any) or not self._known(grams):
            return len(units), 0, 0.0, None, ""
        found = [f for f in map(self.unit, units) if f]
        within = [[x] for x in self.runs(text, grams, {name for f in found for _, name in f})]
        found += within
        each = [x for f in found for x in f]
        if not each:
            return len(units), 0, 0.0, None, ""
        n_units = len(units) + len(within)
        best = min(each, key=lambda x: (-x[0], x[1]))
        return n_units, len(found), best[0], best[1], ",".join(sorted({x[1] for x in each}))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, n_units, n_matches, best_dice, best_license, licenses)`` of every document."""
    chosen = TEMPLATES | {f"{name}-text": t for name, t in license_texts().items()} if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, threshold)
        types = (pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string())
        for batch in batches:
            columns = list(zip(*[scanner.text(t) for t in column_bytes(batch, "text")])) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]], names=["doc_id", "n_units", "n_matches", "best_dice", "best_license", "licenses"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_units long, n_matches long, best_dice double, best_license string, licenses string")
