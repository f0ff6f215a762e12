"""License scans by conditional compression.

Method.  Candidate blocks are compressed by zstandard alone and with templates as raw-content dictionaries, templates are ranked by the
bytes that they save, and those that save enough are confirmed by exact wording differences, in the order of their rank: the
words of block and template are aligned, and the template is confirmed if nearly all of its words are there and no marker word (a word that
tells licenses apart: names, versions, clauses) is missing or added inside the matched stretch.

There are two kinds of candidates.  Windows of words, without regard to lines, lie around the rare words of templates, as wide as a template
may reach; their words, joined by single spaces, are compressed, and what a template saves is compared with what it takes itself
(``MIN_SAVED``).  Counts of words leave out windows and templates that could not be confirmed anyway; they name none.  Where
confirmed stretches overlap, the one whose template saves most bytes of it counts.  A run of lines with license
wording (cue words, gaps of one line allowed) is a block; it grows to the lines of the stretches that it meets, and gives one row
per license confirmed in it.  A block without any is ranked and confirmed as a whole.

Scale: one narrow pass without a shuffle; Spark keeps only documents with a cue, in the JVM, before texts go to Python.
Templates are a fixed list, compressors are built once per task.  Alignments are tried only where the words of the template
are there at all, so a text costs time in proportion to its length and the notices in it.

Defined cases: null and empty texts have no blocks.  A block that no template explains is reported with license null and
confirmed false, with its best reduction.  Ties in rank go to the template listed first.  Rows are scanned one by one, so null
or repeated doc_ids are reported as they stand; extra columns are ignored.  Blocks longer than ``MAX_BLOCK_CHARS`` are ranked
in windows that overlap by more than a template, and are one block still.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotweave.llm.batches import pieces

# Common wordings of license notices.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software"
)
_MIT_TERMS = (
    ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
    "notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
    "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
    "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary "
    "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution. "
)
_BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
    "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy "
    "of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the "
    "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
)
_GNU = "is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version."
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + " See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT_GRANT + "."),
    ("MIT", _MIT_GRANT + _MIT_TERMS),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("GPL-3.0", "This program " + _GNU.format(":", "General Public License", ",", "3")),
    ("GPL-2.0", "This program " + _GNU.format(";", "General Public License", ";", "2")),
    ("AGPL-3.0", "This program " + _GNU.format(":", "Affero General Public License", ",", "3")),
    ("LGPL-3.0", "This library " + _GNU.format(":", "Lesser General Public License", ",", "3")),
    ("LGPL-2.1", "This library " + _GNU.format(";", "Lesser General Public License", ";", "2.1")),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", _BSD_TWO + _BSD_THIRD + _BSD_DISCLAIMER),
    ("BSD-2-Clause", _BSD_TWO + _BSD_DISCLAIMER),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
)
# Words that tell licenses apart, missing from a notice or added inside it.
MARKERS = frozenset(
    "apache mit gnu gpl lgpl agpl affero lesser library bsd mozilla mpl isc boost bsl eclipse epl zlib unlicense creative commons cc cc0 by sa nc nd attribution "
    "sharealike noncommercial noderivatives universal clause endorse promote advertising 1 2 3 4 1.0 1.1 2.0 2.1 2.5 3.0 4.0".split()
)
#: An identifier line for every license named above; "-only" and "-or-later" after it name no other license.
SPDX = tuple((name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(name for name, _ in TEMPLATES))
_OTHER_ID = re.compile(r"-(?!only\b|or-later\b)\w")
CUES = r"(?i)licen[sc]|copyright|permission\s+is\s+hereby|public\s+domain|warrant(y|ies)|creative\s+commons|spdx|redistribution"
_CUE = re.compile(CUES)
_WORD = re.compile(r"\w+(?:\.\w+)*")
MAX_BLOCK_CHARS = 8_000
MIN_REDUCTION = 0.15
MIN_PRESENT = 0.9
#: A template that saves less than this share of what it takes itself is not looked for in a window.
MIN_SAVED = 0.1
_FRAME = len(zstandard.ZstdCompressor(level=9, write_content_size=False).compress(b""))
MATCH = 8  # a matched word is worth this many added ones in a local alignment


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def line_starts(lines: list[str]) -> list[int]:
    out, at = [], 0
    for line in lines:
        out.append(at)
        at += len(line) + 1
    return out


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """(first line, last line) of every run of cue lines."""
    starts = line_starts(text.split("\n"))
    marked = sorted({i for m in _CUE.finditer(text) for i in range(bisect_right(starts, m.start()) - 1, bisect_right(starts, m.end() - 1))})
    runs: list[list[int]] = []
    for i in marked:
        if runs and i - runs[-1][1] <= 2:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    yield from map(tuple, runs)


def windows(block: str, overlap: int, max_chars: int | None = None) -> Iterator[str]:
    """The block, or pieces of it of which any ``overlap`` consecutive characters are in one."""
    size = MAX_BLOCK_CHARS if max_chars is None else max_chars
    for start in range(0, max(1, len(block) - overlap), size - overlap):
        yield block[start : start + size]


def alignment(block: list[str], template: list[str]) -> tuple[list[str], list[str]]:
    """Template words missing from the block, and block words added between the first and last matched one (by a longest
    common subsequence)."""
    n, m = len(block), len(template)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if block[i] == template[j] else max(below[j], row[j + 1])
    i = j = 0
    matched_i, matched_j = [], set()
    while i < n and j < m:
        if block[i] == template[j] and best[i][j] == best[i + 1][j + 1] + 1:
            matched_i.append(i)
            matched_j.add(j)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    missing = [w for k, w in enumerate(template) if k not in matched_j]
    if not matched_i:
        return missing, block
    taken = set(matched_i)
    return missing, [block[k] for k in range(matched_i[0], matched_i[-1]) if k not in taken]


def _paths(block: list[str], template: list[str]) -> dict[int, tuple[int, tuple]]:
    """By place in the template: score and matches (linked, last first) of the best local alignment that ends with the last
    word of ``block`` there."""
    m = len(template)
    above: list[tuple] = [(0, None)] * (m + 1)  # best so far, less the words added since
    ends = {}
    for i, word in enumerate(block):
        row: list[tuple] = [(0, None)] * (m + 1)
        for j in range(m):
            far = (above[j + 1][0] - 1, above[j + 1][1])
            best = row[j] if row[j][0] >= far[0] else far
            if word == template[j]:
                before, path = above[j]
                one = (MATCH + before, ((i, j), path)) if before > 0 else (MATCH, ((i, j), None))
                if i == len(block) - 1:
                    ends[j] = one
                if one[0] > best[0]:
                    best = one
            row[j + 1] = best if best[0] > 0 else (0, None)
        above = row
    return ends


def _unlink(path: tuple | None) -> list[tuple[int, int]]:
    out = []
    while path is not None:
        out.append(path[0])
        path = path[1]
    return out


def alignment_at(block: list[str], at: int, template: list[str]) -> list[tuple[int, int]]:
    """(word of block, word of template) matched by the best local alignment through ``block[at]``."""
    reach = len(template) + max(4, len(template) // 2)
    first = max(0, at - reach)
    left = _paths(block[first : at + 1], template)
    right = _paths(block[at : at + reach + 1][::-1], template[::-1])
    m, last = len(template), min(len(block), at + reach + 1) - 1
    j = max(left, key=lambda j: (left[j][0] + right[m - 1 - j][0], -j))
    before = [(first + i, k) for i, k in reversed(_unlink(left[j][1]))]
    return before + [(last - i, m - 1 - k) for i, k in _unlink(right[m - 1 - j][1])[1:]]


class Scanner:
    """Templates with their compressors."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES + SPDX):
        self.names = [t[0] for t in templates]
        self.words = [words(t[1]) for t in templates]
        self.counts = [Counter(ws) for ws in self.words]
        self.known = {w for ws in self.words for w in ws}
        self.longest = 2 * max((len(t[1]) for t in templates), default=0)
        self.identifier = [t[1].startswith("SPDX") for t in templates]
        self.size = [len(zstandard.ZstdCompressor(level=9, write_content_size=False).compress(" ".join(ws).encode())) - _FRAME for ws in self.words]
        self.plain = zstandard.ZstdCompressor(level=9, write_content_size=False)
        self.primed, self.primed_words = (
            [
                zstandard.ZstdCompressor(level=9, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
                for text in texts
            ]
            for texts in ([t[1].lower() for t in templates], [" ".join(ws) for ws in self.words])
        )

    def rank(self, block: str) -> list[tuple[float, int]]:
        """(share of the compressed size saved, template) in falling order."""
        raw = block.lower().encode()
        alone = len(self.plain.compress(raw))
        gains = [(1 - len(c.compress(raw)) / alone, k) for k, c in enumerate(self.primed)]
        return sorted(gains, key=lambda g: (-g[0], g[1]))

    def may_hold(self, held: Counter, k: int) -> bool:
        """Whether so many of the template's words are there that it could be confirmed."""
        there = sum(min(n, held.get(w, 0)) for w, n in self.counts[k].items())
        return there >= MIN_PRESENT * len(self.words[k])

    def confirm(self, block: list[str], k: int) -> tuple[bool, int, int]:
        return self._judge(*alignment(block, self.words[k]), k)

    def _judge(self, missing: list[str], extra: list[str], k: int) -> tuple[bool, int, int]:
        present = 1 - len(missing) / max(1, len(self.words[k]))
        told = MARKERS.intersection(missing) or MARKERS.intersection(extra)
        return present >= MIN_PRESENT and not told, len(missing), len(extra)

    def _rare(self, k: int, places: dict[str, list[int]]) -> list[str]:
        """Words of a template one of which must be there: its rarest marker, or as many of its rarest words as cannot all be missing."""
        rarest = sorted(set(self.words[k]), key=lambda w: (len(places.get(w, ())), w))
        return [w for w in rarest if w in MARKERS][:1] or rarest[: int(len(self.words[k]) * (1 - MIN_PRESENT)) + 1]

    def anchors(self, k: int, places: dict[str, list[int]], first: int, last: int) -> list[int]:
        """Places of those words in a window."""
        return sorted(i for w in self._rare(k, places) for i in places.get(w, ())[bisect_left(places.get(w, ()), first) : bisect_left(places.get(w, ()), last)])

    def candidates(self, own: list[str], places: dict[str, list[int]]) -> list[tuple[int, int]]:
        """Windows (first word, last word + 1) that may hold a notice: around the rare words of each template, as wide as the template
        may reach.  Counts of words leave out windows in which it could not be confirmed."""
        held = Counter({w: len(at) for w, at in places.items()})
        out = set()
        for k, template in enumerate(self.words):
            if any(w in MARKERS and w not in places for w in template) or not self.may_hold(held, k):
                continue
            reach = len(template) + max(4, len(template) // 2)
            for at in self.anchors(k, places, 0, len(own)):
                first, last = max(0, at - reach), min(len(own), at + reach + 1)
                if self.may_hold(Counter(w for w in own[first:last] if w in self.counts[k]), k):
                    out.add((first, last))
        return sorted(out)

    def rank_window(self, own: list[str]) -> list[tuple[int, float]]:
        """(template, bytes that it saves of the window as a share of what the template itself takes), falling.  Templates of
        which too few words are there are left out."""
        held = Counter(own)
        raw = " ".join(own).encode()
        alone = len(self.plain.compress(raw))
        ranked = [(k, (alone - len(c.compress(raw))) / max(1, self.size[k])) for k, c in enumerate(self.primed_words) if self.may_hold(held, k)]
        return sorted(ranked, key=lambda r: (-r[1], r[0]))

    def notices(self, text: str) -> list[tuple[int, int, str, float, int, int]]:
        """(start, end, license, reduction, missing, extra) of confirmed stretches anywhere in the text, none overlapping."""
        spans = [(m.start(), m.end(), m.group().lower()) for m in _WORD.finditer(text)]
        own = [w for _, _, w in spans]
        places: dict[str, list[int]] = {}
        for i, w in enumerate(own):
            if w in self.known:
                places.setdefault(w, []).append(i)
        held = Counter({w: len(at) for w, at in places.items()})
        found, seen = [], set()
        for first, last in self.candidates(own, places):
            for k, share in self.rank_window(own[first:last]):
                if share < MIN_SAVED:
                    break
                template = self.words[k]
                for at in self.anchors(k, places, first, last):
                    pairs = alignment_at(own, at, template)
                    a, b = pairs[0][0], pairs[-1][0]
                    if (k, a, b) in seen:
                        continue
                    seen.add((k, a, b))
                    taken, matched = {i for i, _ in pairs}, {j for _, j in pairs}
                    ok, missing, extra = self._judge(
                        [w for j, w in enumerate(template) if j not in matched], [own[i] for i in range(a, b) if i not in taken], k
                    )
                    if ok and not (self.identifier[k] and _OTHER_ID.match(text, spans[b][1])):
                        raw = text[spans[a][0] : spans[b][1]].lower().encode()
                        found.append((len(self.plain.compress(raw)), len(self.primed[k].compress(raw)), extra, k, a, b, missing))
                        break
        out, used = [], set()
        for alone, primed, extra, k, a, b, missing in sorted(found, key=lambda f: (f[1] - f[0], f[2], f[3], f[4])):
            if used.isdisjoint(range(a, b + 1)):
                used.update(range(a, b + 1))
                out.append((spans[a][0], spans[b][1], self.names[k], 1 - primed / alone, missing, extra))
        return sorted(out)

    def report(self, text: str) -> Iterator[tuple[int, int, str | None, float, int | None, int | None]]:
        """First line, last line, license, reduction, missing and extra words: the rows of one text."""
        lines = text.split("\n")
        starts = line_starts(lines)
        told = [(bisect_right(starts, n[0]) - 1, bisect_right(starts, n[1] - 1) - 1, n) for n in self.notices(text)]
        grown: list[tuple[int, int, list]] = []
        for a, b, notice in sorted([(a, b, None) for a, b in blocks(text)] + told, key=lambda x: (x[0], x[1])):
            if grown and a <= grown[-1][1] + 2:
                first, last, inside = grown.pop()
                grown.append((first, max(last, b), inside + [notice] * (notice is not None)))
            else:
                grown.append((a, b, [notice] * (notice is not None)))
        for a, b, inside in grown:
            if not inside:
                yield a, b, *self.scan("\n".join(lines[a : b + 1]))
                continue
            seen = set()
            for _, _, name, gain, missing, extra in sorted(inside):
                if name not in seen:
                    seen.add(name)
                    yield a, b, name, gain, missing, extra

    def scan(self, block: str) -> tuple[str | None, float, int | None, int | None]:
        """License, reduction, missing and extra words of the best confirmed template; else license None and the best reduction."""
        best = 0.0
        for window in windows(block, self.longest):
            ranked = self.rank(window)
            best = max(best, ranked[0][0])
            own = words(window)
            held = Counter(own)
            for gain, k in ranked:
                if gain < MIN_REDUCTION:
                    break
                if not self.may_hold(held, k):
                    continue
                ok, missing, extra = self.confirm(own, k)
                if ok and not self.identifier[k]:
                    return self.names[k], gain, missing, extra
        return None, best, None, None


def _scan(templates: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            for part in pieces(batch):
                out: list[list] = [[] for _ in range(8)]
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    for first, last, name, gain, missing, extra in scanner.report(text):
                        for column, value in zip(out, (doc_id, first, last, name, round(gain, 6), missing, extra, name is not None)):
                            column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], _NAMES)

    return run


_NAMES = ["doc_id", "first_line", "last_line", "license", "reduction", "n_missing", "n_extra", "confirmed"]


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES + SPDX) -> DataFrame:
    """doc_id, first_line, last_line, license, reduction, n_missing, n_extra, confirmed: one row per candidate block and license."""
    cued = docs.select("doc_id", "text").filter(F.col("text").rlike(CUES))
    return cued.mapInArrow(
        _scan(templates),
        "doc_id long, first_line long, last_line long, license string, reduction double, n_missing long, n_extra long, confirmed boolean",
    )
