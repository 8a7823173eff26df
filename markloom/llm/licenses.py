"""License scans by conditional compression against notice templates.

A paragraph with a licence cue is read as words. Around each cue, a window of each template's
reach is compared with the template word by word, whatever the length of the line: the
template's words must be there in order, but for blanks such as years and holders; a few may
be lost and some added, and the differences are reported. Of the confirmed spans that
overlap, the one with most words of its template stays, then that with the greater relative
reduction of its size by zstandard when the template is its raw dictionary. Only the words of
a span are used up; the rest of the paragraph is scanned for more.

Work is per row, with no shuffle, so skewed keys don't matter; whole texts are read.

Defined results for odd input
    null or empty text   no notice found
    null doc_id          scanned like any other row
    repeated rows        each is returned
    ties of both         the template that comes first in TEMPLATES
    empty table          empty result
    extra columns        ignored
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Well-known notices, and the paragraphs of well-known licences. <...> stands for up to BLANK words.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-or-later", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("All-Rights-Reserved", "Copyright <year> <holder>. All rights reserved."),
    ("All-Rights-Reserved", "All rights reserved."),
)

CUES = r"(?i)licen[sc]|copyright|©|\(c\)|spdx|public\s+domain|free\s+of\s+charge|redistribut|unencumbered|all\s+rights\s+reserved|\bcc0\b|\bcc\s+by|as[\s-]+is[\"'”’]|without\s+any\s+(?:warranty|express)|free\s+to\s+copy"
BLANK = 8
#: Share of a template's words that must be in the block, in order.
LEAST_COVERED = 0.9
#: Words that name the licence: if one of these differs, the template is not confirmed.
NAMING = re.compile(r"\d|^(nc|nd|sa|by|cc|cc0|mit|bsd|isc|apache|gnu|lesser|affero|mozilla|gpl|lgpl|agpl|mpl|attribution)$")
WORD = re.compile(r"<\w+>|[\w.]*\w", re.UNICODE)
PARAGRAPH = re.compile(r"\n\s*\n")


class Template:
    """The words of a notice, and where a text holds them."""

    def __init__(self, text: str) -> None:
        self.words = WORD.findall(text.lower())
        self.fixed = Counter(w for w in self.words if w[0] != "<")
        self.size = self.fixed.total()
        self.names = {w for w in self.fixed if NAMING.search(w)}
        self.may_lose = max(k for k in range(self.size + 1) if (self.size - k) / self.size >= LEAST_COVERED)
        # Short notices that name no licence, such as "All rights reserved.", are only their wording.
        self.may_add = len(self.words) + BLANK if self.names or self.size >= 10 else 1
        self.reach = len(self.words) + self.may_add + BLANK * (len(self.words) - self.size)

    def likely(self, have: Counter) -> bool:
        """Could this many of its words be there? Loses no span."""
        return all(w in have for w in self.names) and (self.fixed & have).total() >= self.size - self.may_lose

    def spans(self, have: list[str], naming: list[bool]) -> list[tuple[int, int, int, int]]:
        """(words lost, words added, first word, word after the end) of the best span for each end."""
        # Best (lost, added, -first) with the template's words so far up to each word of the text.
        row = {j: (0, 0, -j) for j in range(len(have) + 1)}
        places: dict[str, list[int]] = {}
        for j, w in enumerate(have):
            places.setdefault(w, []).append(j)
        for i, w in enumerate(self.words):
            after: dict[int, tuple[int, int, int]] = {}
            if w[0] == "<":
                for j, state in row.items():
                    for k in range(j, min(j + BLANK, len(have)) + 1):
                        if k not in after or state < after[k]:
                            after[k] = state
            else:
                for j in places.get(w, ()):
                    if j in row:
                        after[j + 1] = row[j]
                if w not in self.names:
                    for j, (lost, added, first) in row.items():
                        state = (lost + 1, added, first)
                        if lost < self.may_lose and (j not in after or state < after[j]):
                            after[j] = state
            row = after
            if i + 1 < len(self.words):
                for start in sorted(row):  # added words
                    j = start
                    while j < len(have) and not naming[j] and row[j][1] < self.may_add:
                        lost, added, first = row[j]
                        state = (lost, added + 1, first)
                        j += 1
                        if j in row and row[j] <= state:
                            break
                        row[j] = state
        return [(lost, added, -first, j) for j, (lost, added, first) in row.items() if -first < j]

    def differences(self, have: list[str]) -> list[str]:
        out = []
        for op, a, b, c, d in difflib.SequenceMatcher(None, self.words, have, autojunk=False).get_opcodes():
            lost, got = self.words[a:b], have[c:d]
            blanks = sum(w[0] == "<" for w in lost)
            if op != "equal" and not (blanks and blanks == len(lost) and len(got) <= BLANK * blanks):
                out.append(f"-{' '.join(lost)} +{' '.join(got)}")
        return out


@dataclass
class Scanner:
    level: int = 3
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    ready: list = field(default_factory=list)

    def __post_init__(self) -> None:
        import zstandard

        self.zstd = zstandard
        self.alone = zstandard.ZstdCompressor(level=self.level, write_content_size=False, write_checksum=False)
        for name, text in self.templates:
            # A raw dictionary has at least 8 bytes; short notices are repeated.
            raw = (text + "\n").encode()
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.ready.append((name, Template(text), zstandard.ZstdCompressor(level=self.level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)))

    def reduction(self, block: str, k: int) -> float:
        """By how much the template as dictionary reduces the compressed size."""
        raw = block.encode("utf-8", "surrogatepass")
        return 1 - len(self.ready[k][2].compress(raw)) / len(self.alone.compress(raw))

    def windows(self, reach: int, cues: list[int], gaps: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """Runs of words within reach of a cue, merged, and cut to the gaps between used words."""
        merged: list[list[int]] = []
        for c in cues:
            if merged and c - reach <= merged[-1][1]:
                merged[-1][1] = c + reach + 1
            else:
                merged.append([c - reach, c + reach + 1])
        g = 0
        for a, b in merged:
            while g < len(gaps) and gaps[g][1] <= a:
                g += 1
            k = g
            while k < len(gaps) and gaps[k][0] < b:
                yield max(a, gaps[k][0]), min(b, gaps[k][1])
                k += 1

    def notices(self, text: str, cue: re.Pattern) -> list[tuple[int, str, float, float, list[str]]]:
        """(place in the text, name, reduction, share of words found, differences) of a paragraph's notices."""
        at = [(m.start(), m.end()) for m in WORD.finditer(text)]
        have = [text[a:b].lower() for a, b in at]
        naming = [bool(NAMING.search(w)) for w in have]
        ends = [b for _, b in at]
        cues = [bisect.bisect_right(ends, m.start()) for m in cue.finditer(text)]
        counted = Counter(have)
        left = [k for k, (_, t, _) in enumerate(self.ready) if t.likely(counted)]
        out, gaps = [], [(0, len(have))]
        while left and gaps:
            tried = []
            for k in left:
                t = self.ready[k][1]
                for a, b in self.windows(t.reach, cues, gaps):
                    if t.likely(Counter(have[a:b])):
                        for lost, added, first, end in t.spans(have[a:b], naming[a:b]):
                            block = text[at[a + first][0] : at[a + end - 1][1]]
                            tried.append((lost - t.size, lost, added, -self.reduction(block, k), k, a + first, a + end))
            taken: list[tuple[int, int]] = []  # sorted, apart
            for _, lost, _, reduced, k, first, end in sorted(tried):
                p = bisect.bisect_left(taken, (first, end))
                if p < len(taken) and taken[p][0] < end or p and taken[p - 1][1] > first:
                    continue
                taken.insert(p, (first, end))
                name, t, _ = self.ready[k]
                out.append((at[first][0], name, -reduced, 1 - lost / t.size, t.differences(have[first:end])))
            if len(taken) == len(tried):
                break
            rest = []
            for a, b in gaps:
                for first, end in taken[bisect.bisect_left(taken, (a, a)) : bisect.bisect_left(taken, (b, b))]:
                    rest.append((a, first))
                    a = end
                rest.append((a, b))
            gaps = [(a, b) for a, b in rest if a < b]
        return sorted(out, key=lambda x: x[0])

    def scan(self, text: str) -> list[dict]:
        """Confirmed notices of a whole text, by line."""
        found, cue = [], re.compile(CUES)
        breaks = [m.start() for m in re.finditer("\n", text)]
        starts = [0, *(m.end() for m in PARAGRAPH.finditer(text)), len(text)]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if cue.search(text, a, b):
                for place, name, reduced, share, changes in self.notices(text[a:b], cue):
                    line = bisect.bisect_left(breaks, a + place)
                    found.append({"line": line, "license": name, "reduction": round(reduced, 4), "covered": round(share, 4), "differences": changes})
        return found


FOUND = pa.list_(
    pa.struct([("line", pa.int32()), ("license", pa.string()), ("reduction", pa.float64()), ("covered", pa.float64()), ("differences", pa.list_(pa.string()))])
)
SCHEMA = "doc_id long, notices array<struct<line int, license string, reduction double, covered double, differences array<string>>>"


def _scan(templates: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates=templates)
        for batch in batches:
            likely = pc.fill_null(pc.match_substring_regex(batch.column(1), CUES), False).to_pylist()
            rows = [scanner.scan(t.as_py()) if x else [] for t, x in zip(batch.column(1), likely, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, FOUND)], ["doc_id", "notices"])

    return run


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id and its confirmed notices (maybe none): one row for each input row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_scan(templates), SCHEMA)
