"""License scan by conditional compression.

Candidate blocks are the words around license cue words. A block is compressed alone and with each template as zstandard's raw dictionary;
templates are ranked by the bytes that they save, and every one that saves some is confirmed by its exact wording: the words that block and template
share in order, and every word that was changed, added or left out. Of those confirmed the one with the most words found, less
those missing, counts. What a confirmed match covers is cut out and both sides are searched
again, so repeated and neighbouring licenses are each found. Whole license texts are searched first, then short notices in what is left.

Rows without a cue never leave the JVM. Blocks are bounded by a multiple of the longest template, so a long text costs time in
proportion to its cues.

Defined results: a null or empty text has no rows, nor has a text without cues or without a confirmed template. Equal findings go by savings, then by the
template's name. Repeated rows give repeated findings; an empty table an empty result; further columns are ignored. Positions
are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.llm._words import map_texts, only

#: Wording of common notices.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved. No part of this work may be reproduced without permission.",
}
#: Whole license texts (without their copyright lines), which all disclaim warranty.
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
TEXTS: dict[str, str] = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause-text": _BSD + _DISCLAIMER,
    "BSD-3-Clause-text": _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _DISCLAIMER,
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
    "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
    "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
    "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
    "binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
    "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
    "future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
    "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim "
    "that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, "
    "and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
CUE = r"(?i)licen[sc]e|copyright|redistribut|permission|all[\W_]+rights[\W_]+reserved"
_cue = re.compile(CUE)
_word = re.compile(r"[^\x20\x09-\x0D]+")
_edge = re.compile(r"^[\W_]+|[\W_]+$")


def plain(word: str) -> str:
    return _edge.sub("", word).lower()


class Scanner:
    """Templates with their compressors; ``cover`` is the share of a template's words that must be there in order."""

    def __init__(self, templates: Mapping[str, str] = TEMPLATES, cover: float = 0.8, least: int = 4) -> None:
        self.cover, self.least = cover, least
        self.words = {name: [plain(w) for w in text.split()] for name, text in sorted(templates.items())}
        self.reach = max(map(len, self.words.values()))
        self.counts = [Counter(words) for words in self.words.values()]
        self.alone = self._compressor(None)
        self.given = {name: self._compressor(" ".join(words).encode()) for name, words in self.words.items()}

    @staticmethod
    def _compressor(raw: bytes | None) -> zstandard.ZstdCompressor:
        form = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if raw is None:
            return zstandard.ZstdCompressor(level=19, **form)
        return zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **form)

    def possible(self, words: list[str]) -> bool:
        """Whether the words hold the share ``cover`` of some template's words, in any order: without that, nothing can be confirmed."""
        if len(words) < self.cover * min(map(len, self.words.values())):
            return False
        have = Counter(words)
        return any(sum(min(n, have[w]) for w, n in own.items()) >= self.cover * own.total() for own in self.counts)

    def savings(self, words: list[str]) -> list[tuple[int, str]]:
        """Bytes saved by each template, most first."""
        block = " ".join(words).encode()
        alone = len(self.alone.compress(block))
        return sorted(((alone - len(c.compress(block)), name) for name, c in self.given.items()), key=lambda x: (-x[0], x[1]))

    def confirm(self, words: list[str], name: str) -> tuple[float, int, int, str] | None:
        """Share of the template found in order, first and end word of the match, and the differences."""
        template = self.words[name]
        if (Counter(template) & Counter(words)).total() < self.cover * len(template):
            return None
        if found := self._aligned(template, words):
            return found
        # words of the template elsewhere led the alignment astray: from each of its words as much as a match may span, the densest first
        span, wanted = 2 * len(template) + 8, set(template)
        starts = []
        for k, w in enumerate(words):
            if w in wanted and len(words) > span:
                shared = (Counter(template) & Counter(words[k : k + span])).total()
                if shared >= self.cover * len(template):
                    starts.append((-shared, k))
        for _, k in sorted(starts):
            if found := self._aligned(template, words[k : k + span]):
                share, begin, end, changed = found
                return share, begin + k, end + k, changed
        return None

    def _aligned(self, template: list[str], words: list[str]) -> tuple[float, int, int, str] | None:
        parts = SequenceMatcher(None, template, words, autojunk=False).get_opcodes()
        same = [(i1, i2, j1, j2) for op, i1, i2, j1, j2 in parts if op == "equal"]
        if not same or sum(i2 - i1 for i1, i2, *_ in same) < self.cover * len(template):
            return None
        begin, end = same[0][2], same[-1][3]
        if end - begin > 2 * len(template) + 8:
            return None
        changed = [f"{op}:{' '.join(template[i1:i2])}>{' '.join(words[max(j1, begin) : min(j2, end)])}" for op, i1, i2, j1, j2 in parts if op != "equal" and (i2 > i1 or (j1 >= begin and j2 <= end))]
        return sum(i2 - i1 for i1, i2, *_ in same) / len(template), begin, end, "; ".join(changed)

    def blocks(self, words: list[str], raw: list[str]) -> list[tuple[int, int]]:
        """Word spans around cues, merged, and cut into overlapping parts of at most 8 reaches."""
        spans: list[list[int]] = []
        for k, w in enumerate(raw):
            if _cue.search(w) or words[k : k + 3] == ["all", "rights", "reserved"]:
                a, e = max(0, k - self.reach), min(len(raw), k + self.reach + 1)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = e
                else:
                    spans.append([a, e])
        out = []
        for a, e in spans:
            while e - a > 8 * self.reach:
                out.append((a, a + 8 * self.reach))
                a += 6 * self.reach
            out.append((a, e))
        return out

    def search(self, words: list[str], raw: list[str], a: int, e: int) -> list[tuple[int, int, str, int, float, str]]:
        todo, found = [(a, e)], []
        while todo:
            a, e = todo.pop()
            if e - a < 3 or not any(_cue.search(w) for w in raw[a:e]) and "reserved" not in words[a:e]:
                continue
            best = None
            for saved, name in self.savings(words[a:e]):
                if saved < self.least:
                    break
                if m := self.confirm(words[a:e], name):
                    order = (2 * m[0] - 1) * len(self.words[name]), m[0], saved  # words found less those missing: neither a shorter notice inside it nor a longer one that it begins
                    if best is None or order > best[0]:
                        best = order, saved, m, name
            if best:
                _, saved, (share, i, j, changed), name = best
                found.append((a + i, a + j, name, saved, share, changed))
                todo += [(a, a + i), (a + j, e)]
        return found

    def within(self, words: list[str], raw: list[str]) -> list[tuple[int, int, str, int, float, str]]:
        """What is found in the words. Blocks overlap where they are cut; of findings of one template that overlap the longest counts."""
        found = sorted({x[:3]: x for a, e in self.blocks(words, raw) for x in self.search(words, raw, a, e)}.values(), key=lambda x: (x[0] - x[1], x))
        kept: list = []
        for x in found:
            if not any(x[2] == y[2] and x[0] < y[1] and y[0] < x[1] for y in kept):
                kept.append(x)
        return sorted(kept)


def find(text: str, scanners: list[Scanner]) -> list[tuple[int, int, str, int, float, str]]:
    """start, end (code points), template, bytes saved, share, differences; by position. Each scanner searches what those before it left."""
    at = [m.span() for m in _word.finditer(text)]
    raw = [text[a:e] for a, e in at]
    words = [plain(w) for w in raw]
    left, found = [(0, len(words))], []
    for s in scanners:
        if not s.possible(words):
            continue
        new = [(a + i, a + j, *rest) for a, e in left for i, j, *rest in s.within(words[a:e], raw[a:e])]
        found += new
        left = [gap for a, e in left for gap in _gaps(a, e, sorted(x[:2] for x in new))]
    return [(at[i][0], at[j - 1][1], *rest) for (i, j, *rest) in sorted(found)]


def _gaps(a: int, e: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for i, j in spans:
        if a <= i < e:
            out.append((a, i))
            a = max(a, j)
    return [(x, y) for x, y in [*out, (a, e)] if x < y]


def scan(documents: DataFrame, templates: Mapping[str, str] = TEMPLATES, whole: Mapping[str, str] = TEXTS, cover: float = 0.8, text: str = "text", id: str = "doc_id") -> DataFrame:
    """A row for each confirmed license: doc_id, license, start, end, saved_bytes, cover, differences. Whole texts are searched before short wording."""
    templates, whole = dict(templates), dict(whole)
    own: list[Scanner] = []

    def work(part: pa.RecordBatch, texts: list[bytes]) -> dict:
        if not own:
            own.extend((Scanner(whole, cover), Scanner(templates, cover)))
        rows = [(key, *x) for key, t in zip(part.column(0).to_pylist(), map(bytes.decode, texts), strict=True) for x in find(t, own)]
        names = ("doc_id", "start", "end", "license", "saved_bytes", "cover", "differences")
        return {n: [r[k] for r in rows] for k, n in enumerate(names)}

    some = only(documents, id, text).where(F.col(text).rlike(CUE))
    return map_texts(some, work, "doc_id long, license string, start long, end long, saved_bytes long, cover double, differences string", text)
