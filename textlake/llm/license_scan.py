"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from textlake.llm.runtime import drop_extra

WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")

# The common text of two licenses, and notices and texts by which works name or carry their license
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. {third}"
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "proprietary": "All rights reserved.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH "
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
        "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": _BSD.format(third=""),
    "BSD-3-Clause": _BSD.format(
        third="Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
    ),
}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of ``pairs`` (in order of the first) whose seconds increase."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int | None] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        back.append(at[k - 1] if k else None)
        tails[k:] = [b, *tails[k + 1 :]]
        at[k:] = [i, *at[k + 1 :]]
    out, i = [], at[-1] if at else None
    while i is not None:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched (text place, template place) pairs, both increasing: anchors are words that stand once in
    either side, their longest increasing run holds, and the gaps between are aligned in the same way; where
    a gap has no such word, its equal ends match."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and text[a0] == template[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and text[a1 - 1] == template[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        here, there = Counter(text[a0:a1]), Counter(template[b0:b1])
        place = {w: i for i, w in enumerate(text[a0:a1], a0) if here[w] == 1 and there.get(w) == 1}
        run = _increasing(sorted((place[w], j) for j, w in enumerate(template[b0:b1], b0) if w in place))
        ends = [(a0 - 1, b0 - 1), *run, (a1, b1)]
        out += run
        if run:
            gaps += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(ends, ends[1:])]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float, stretch: int = 2):
        self.coverage, self.stretch = coverage, stretch
        self.templates = [(name, w, Counter(w)) for name, w in ((n, words_of(t)) for n, t in sorted(templates.items())) if w]

    def regions(self, words: list[str], size: int, counts: Counter) -> list[tuple[int, int]]:
        """Stretches that may cover the template: in a window of ``stretch`` template lengths, enough of the
        template's words must stand (each as often as the template has it, at most). Overlapping windows join."""
        width = self.stretch * size
        hits = [i for i, w in enumerate(words) if w in counts]
        need = self.coverage * size
        inside: Counter = Counter()
        have, first, out = 0, 0, []
        for i in hits:
            w = words[i]
            inside[w] += 1
            have += inside[w] <= counts[w]
            while i - hits[first] >= width:
                gone = words[hits[first]]
                have -= inside[gone] <= counts[gone]
                inside[gone] -= 1
                first += 1
            if have >= need:
                if out and hits[first] <= out[-1][1]:
                    out[-1][1] = i + 1
                else:
                    out.append([hits[first], i + 1])
        return [(a, b) for a, b in out]

    def tight(self, words: list[str], a: int, b: int, template: list[str], width: int) -> tuple[int, int, int] | None:
        """(aligned words, first, last + 1) at the first place of words[a:b] where enough of the template's words
        stand in order within ``width`` words; the longest such run that ends there, as short as it can be."""
        need = self.coverage * len(template)
        row = [(0, 0)] * (len(template) + 1)  # aligned words and where they begin: of equally many, the later
        for i in range(a, b):
            w, last, hit = words[i], (0, 0), False
            for j, t in enumerate(template, 1):
                old = row[j]
                new = max(old, row[j - 1])
                if w == t:
                    hit = True
                    new = max(new, (last[0] + 1, last[1] if last[0] else i))
                last, row[j] = old, new
            n, first = row[-1]
            if hit and n >= need:
                if i - first < width:
                    return n, first, i + 1
                if (close := self.tight(words, i - width + 1, i + 1, template, width)) is not None:
                    return close
        return None

    def places(self, words: list[str], a: int, b: int, template: list[str], counts: Counter) -> list[tuple[float, int, int]]:
        """(coverage, first, last) of each place of the template in a region, from left to right. A region that can
        hold one place only is aligned whole; else, or where that fails, the single places are aligned in turn."""
        size, width = len(template), self.stretch * len(template)
        if sum(w in counts for w in words[a:b]) < 2 * self.coverage * size:
            pairs = patience(words[a:b], template)
            if len(pairs) >= self.coverage * size:
                return [(len(pairs) / size, a + pairs[0][0], a + pairs[-1][0])]
        out = []
        while (found := self.tight(words, a, b, template, width)) is not None:
            n, first, end = found
            # later words join a place as long as they add to it and are no place of their own
            for i in range(end, min(b, first + width)):
                if words[i] in counts:
                    if self.tight(words, end, i + 1, template, width) is not None:
                        break
                    if (more := len(patience(words[first : i + 1], template))) > n:
                        n, end = more, i + 1
            out.append((n / size, first, end - 1))
            a = end
        return out

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, first word, last word, places) for each template that the text covers."""
        words = words_of(text) if text else []
        if not words:
            return []
        there = set(words)
        spots: list[tuple[float, int, int, int, str]] = []
        for name, template, counts in self.templates:
            if sum(n for w, n in counts.items() if w in there) < self.coverage * len(template):
                continue
            for a, b in self.regions(words, len(template), counts):
                spots += [(cover, first, last, len(template), name) for cover, first, last in self.places(words, a, b, template, counts)]
        # where places of templates overlap, the better covered one speaks, of equals the longer template; each
        # place is judged by itself, so a license that loses one place keeps its others
        found: dict[str, list] = {}
        taken: list[tuple[int, int]] = []  # disjoint, in text order
        for cover, first, last, _, name in sorted(spots, key=lambda x: (-x[0], -x[3], x[1], x[4])):
            k = bisect_left(taken, (first, first))
            if (k and taken[k - 1][1] >= first) or (k < len(taken) and taken[k][0] <= last):
                continue
            taken.insert(k, (first, last))
            best = found.setdefault(name, [cover, first, last, 0])
            best[3] += 1
        return [(name, round(cover, 6), first, last, places) for name, (cover, first, last, places) in sorted(found.items())]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """doc_id, license, coverage, first_word, last_word, places: a row for each document and license template
    of which at least ``coverage`` of the words align. Words are folded in case and lose punctuation.

    Whole texts are read where they lie, no shuffle. Null text, empty text or no match: no row. Several
    places: the best covered (of equals the first) and their number. Where places of several templates overlap,
    the better covered one counts, of equals the longer template. Templates must fit a closure: they are
    a list kept by hand. Repeated rows: each scanned. Empty table: no rows. Extra columns of any name are left alone.
    """
    chosen = dict(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, coverage)
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for row in scanner.scan(text):
                    at.append(i)
                    rows.append(row)
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names)

    names = ["doc_id", "license", "coverage", "first_word", "last_word", "places"]
    d = drop_extra(docs, "doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, license string, coverage double, first_word long, last_word long, places long")
