"""License scan by conditional compression.

Templates are short notices (below) and whole license texts (``wordings``). A text
is split into units (sentences within lines). A unit is license-like for the
templates whose runs of four words cover half of it (shorter units: that have it as
a run); of a unit that is like none, stretches of at least ``STRETCH`` words in such
runs are units of their own; consecutive units that one
template could hold form a candidate block, which ends where its first unit comes again (the
next copy of a notice) or where it outgrows the template. A block is compressed with
each template as a zstandard raw dictionary; templates are ranked by the reduction
of its size against compression without one. The best ``CANDIDATES`` are confirmed by
exact wording, up to the first that agrees word by word: the block's words are aligned with the template's, and a template is
accepted if at least ``threshold`` (0.8) of the block's words agree. A block that
no template fits is judged unit by unit. The result names the words that differ on
either side.

Edge cases: null and empty texts, and texts without four words in a row (or an SPDX
tag) of a template, give no row. Texts of any length are scanned whole; a block has
at most a quarter more words than its longest template, so an alignment is bounded.
Ties rank by license name. Repeated rows each get their rows. An empty table gives
an empty result. Other columns, whatever their names, are not used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache
from importlib import resources

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agreemill.llm.common import col, small_batches

THRESHOLD = 0.8
CANDIDATES = 6
RUN = 4
COVER = 0.5
STRETCH = 12
#: Words between two runs of a stretch, at most.
GAP = 3
SPDX = "spdx-license-identifier"
CACHE = 20_000

#: Notice and license wordings as their stewards publish them.
TEMPLATES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License. SPDX-License-Identifier: Apache-2.0""",
    "MIT": """Released under the MIT License. Licensed under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. SPDX-License-Identifier: MIT""",
    "BSD-3-Clause": """Released under the BSD License. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE. SPDX-License-Identifier: BSD-3-Clause""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE. SPDX-License-Identifier: BSD-2-Clause""",
    "ISC": """Released under the ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE. SPDX-License-Identifier: ISC""",
    "GPL-2.0-only": """This work is licensed under the GNU General Public License, version 2. This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA. SPDX-License-Identifier: GPL-2.0-only""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA. SPDX-License-Identifier: GPL-2.0-or-later""",
    "GPL-3.0-only": """This work is licensed under the GNU General Public License, version 3. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>. SPDX-License-Identifier: GPL-3.0-only""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>. SPDX-License-Identifier: GPL-3.0-or-later""",
    "LGPL-3.0-or-later": """This work is licensed under the GNU Lesser General Public License, version 3. This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>. SPDX-License-Identifier: LGPL-3.0-or-later""",
    "AGPL-3.0-or-later": """This work is licensed under the GNU Affero General Public License, version 3. This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>. SPDX-License-Identifier: AGPL-3.0-or-later""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/. Licensed under the Mozilla Public License, version 2.0. SPDX-License-Identifier: MPL-2.0""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. SPDX-License-Identifier: Unlicense""",
    "CC-BY-4.0": """Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/. SPDX-License-Identifier: CC-BY-4.0""",
    "CC-BY-SA-4.0": """Licensed under CC BY-SA 4.0. This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/. SPDX-License-Identifier: CC-BY-SA-4.0""",
    "CC-BY-NC-4.0": """Licensed under CC BY-NC 4.0. This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/. SPDX-License-Identifier: CC-BY-NC-4.0""",
    "CC-BY-ND-4.0": """Licensed under CC BY-ND 4.0. This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nd/4.0/. SPDX-License-Identifier: CC-BY-ND-4.0""",
    "CC0-1.0": """To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under CC0 1.0 Universal. SPDX-License-Identifier: CC0-1.0""",
}

_unit = re.compile(r"[^\n]+?(?:[.!?;](?=\s)|(?=\n)|$)", re.S)
_word = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")
_words = _word.findall


@lru_cache(1)
def templates() -> list[tuple[str, str]]:
    """(license, wording) of the notices above and of the whole license texts, by name."""
    whole = [(f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in (resources.files(__package__) / "wordings").iterdir() if f.name.endswith(".txt")]
    return sorted([*TEMPLATES.items(), *whole])


@dataclass
class Finding:
    start: int
    end: int
    license: str
    reduction: float
    words: int
    matched: int
    extra: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)

    @property
    def exact(self) -> bool:
        return not self.extra and not self.missing


def normal(text: str) -> list[str]:
    return _words(text.lower())


class Scanner:
    """Compressors and word runs of the templates, with a bounded memory of blocks."""

    def __init__(self, given: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, candidates: int = CANDIDATES):
        given = templates() if given is None else given
        self.names = [name for name, _ in given]
        self.words = [normal(text) for _, text in given]
        self.runs: dict[tuple[str, ...], list[int]] = {}
        self.short: dict[tuple[str, ...], int] = {}
        self.holders: dict[str, int] = {}
        for i, words in enumerate(self.words):
            for run in set(zip(*(words[k:] for k in range(RUN)), strict=False)):
                self.runs.setdefault(run, []).append(i)
            for word in set(words):
                self.holders[word] = self.holders.get(word, 0) | 1 << i
            for n in range(2, RUN):
                for own in set(zip(*(words[k:] for k in range(n)), strict=False)):
                    self.short[own] = self.short.get(own, 0) | 1 << i
        self.plain = zstandard.ZstdCompressor(level=19, write_content_size=False)
        raw = zstandard.DICT_TYPE_RAWCONTENT
        self.given = [zstandard.ZstdCompressor(level=19, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode("utf-8", "replace"), dict_type=raw)) for w in self.words]
        self.threshold, self.candidates = threshold, candidates
        self.memory: dict[str, Finding | None] = {}

    def candidate(self, text: str) -> bool:
        """Does the text share any run of words, or an SPDX tag, with a template?"""
        words = normal(text)
        return not self.runs.keys().isdisjoint(zip(*(words[k:] for k in range(RUN)), strict=False)) or SPDX in words

    def like(self, words: list[str]) -> int:
        """The templates, as bits, that a unit is like."""
        if len(words) < RUN:
            return self.short.get(tuple(words), 0)
        covered: dict[int, int] = {}
        last: dict[int, int] = {}
        for k in range(len(words) - RUN + 1):
            for i in self.runs.get(tuple(words[k : k + RUN]), ()):
                covered[i] = covered.get(i, 0) + min(RUN, k + RUN - last.get(i, 0))
                last[i] = k + RUN
        return sum(1 << i for i, n in covered.items() if n >= COVER * len(words))

    def units(self, text: str, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, list[str], int]]:
        """(start, end, words, templates it is like) of the units with words."""
        for m in _unit.finditer(text, start, len(text) if end is None else end):
            words = normal(m[0])
            like = self.like(words)
            if words and (like or len(words) < STRETCH):
                yield *m.span(), words, like
            elif words:
                yield from self._stretches(text, *m.span()) or [(*m.span(), words, 0)]

    def _stretches(self, text: str, start: int, end: int) -> list[tuple[int, int, list[str], int]]:
        """The stretches of a long unit that consist of templates' runs, and empty
        units of no template where they end."""
        found = list(_word.finditer(text, start, end))
        words = [m[0].lower() for m in found]
        inside = [False] * len(words)
        for k in range(len(words) - RUN + 1):
            if tuple(words[k : k + RUN]) in self.runs:
                inside[k : k + RUN] = [True] * RUN
        out: list[tuple[int, int, list[str], int]] = []
        first = last = -1
        for k in [*(k for k, x in enumerate(inside) if x), len(words) + GAP + 1]:
            if first >= 0 and k - last > GAP + 1:
                own = words[first : last + 1]
                if len(own) >= STRETCH and (like := self.like(own)):
                    out += [(found[first].start(), found[last].end(), own, like), (found[last].end(), found[last].end(), ["\n"] * STRETCH, 0)]
                first = -1
            if first < 0:
                first = k
            last = k
        return out

    def _room(self, which: int) -> int:
        """The most words of a block that these templates could hold."""
        return 8 + max((len(w) for i, w in enumerate(self.words) if which >> i & 1), default=0) * 5 // 4

    def blocks(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of the candidate blocks, in order."""
        start = end = -1
        which = size = 0
        first: list[str] = []
        for a, b, words, like in self.units(text):
            both = which & like
            if start >= 0 and both and words != first and size + len(words) <= self._room(both):
                end, which, size = b, both, size + len(words)
            elif start >= 0 and not like and len(words) < RUN and which & self._hold(words) and size + len(words) <= self._room(which):
                size += len(words)  # the number of a list item, which a like unit may follow
                continue
            else:
                if start >= 0:
                    yield start, end
                start, end, which, size = (a, b, like, len(words)) if like else (-1, -1, 0, 0)
                first = words if len(words) >= RUN else []
        if start >= 0:
            yield start, end

    def _hold(self, words: list[str]) -> int:
        """The templates that have all these words."""
        which = -1
        for w in words:
            which &= self.holders.get(w, 0)
        return which

    def rank(self, block: str) -> list[tuple[float, int]]:
        """(size reduction, template), best first."""
        data = " ".join(normal(block)).encode("utf-8", "replace")
        whole = len(self.plain.compress(data))
        return sorted(((1 - len(given.compress(data)) / whole, i) for i, given in enumerate(self.given)), key=lambda x: (-x[0], x[1]))

    def confirm(self, block: str, which: int) -> tuple[int, int, list[str], list[str]]:
        """(words, matched, extra words, missing words) against a template.

        Missing words are those the template has between the matched ones.
        """
        own, template = normal(block), self.words[which]
        runs = [m for m in SequenceMatcher(None, own, template, autojunk=False).get_matching_blocks() if m.size]
        matched = sum(m.size for m in runs)
        kept = {i for m in runs for i in range(m.a, m.a + m.size)}
        used = {i for m in runs for i in range(m.b, m.b + m.size)}
        inside = range(runs[0].b, runs[-1].b + runs[-1].size) if runs else range(0)
        return len(own), matched, [w for i, w in enumerate(own) if i not in kept], [template[i] for i in inside if i not in used]

    def judge(self, block: str) -> Finding | None:
        """The confirmed winner of a block: most words matched, fewest differences."""
        best = None
        for reduction, i in self.rank(block)[: self.candidates]:
            words, matched, extra, missing = self.confirm(block, i)
            enough = words >= RUN or (matched == words > 1 and SPDX in block.lower())
            if enough and matched >= self.threshold * words and reduction > 0:
                key = (-matched, len(extra) + len(missing), -reduction, self.names[i])
                if best is None or key < best[0]:
                    best = key, Finding(0, 0, self.names[i], reduction, words, matched, extra, missing)
                if best[1].exact:  # templates come by reduction, so none further on is better
                    break
        return best[1] if best else None

    def recall(self, block: str) -> Finding | None:
        if block not in self.memory:
            if len(self.memory) > CACHE:
                self.memory.clear()
            self.memory[block] = self.judge(block)
        return self.memory[block]

    def scan(self, text: str | None) -> list[Finding]:
        """The confirmed blocks. A block that agrees with no template as a whole
        (several notices in a row) is judged unit by unit."""
        if not text or not self.candidate(text):
            return []
        out = []
        for start, end in self.blocks(text):
            spans = [(start, end)]
            if self.recall(text[start:end]) is None:
                spans = [(a, b) for a, b, _, like in self.units(text, start, end) if like]
            for s, e in spans:
                s += len(text[s:e]) - len(text[s:e].lstrip())
                f = self.recall(text[s:e])
                if f:
                    out.append(Finding(s, e, f.license, f.reduction, f.words, f.matched, f.extra, f.missing))
        return out


_FINDING = "struct<start: int, end: int, license: string, reduction: double, words: int, matched: int, extra: array<string>, missing: array<string>, exact: boolean>"
_KIND = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("reduction", pa.float64()), ("words", pa.int32()), ("matched", pa.int32()), ("extra", pa.list_(pa.string())), ("missing", pa.list_(pa.string())), ("exact", pa.bool_())])


def findings(text: Column) -> Column:
    """array of the confirmed license blocks of a text column."""
    small_batches()

    @F.arrow_udf(f"array<{_FINDING}>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner()
        for batch in batches:
            yield pa.array([[{k: getattr(f, k) for k in _KIND.names} for f in scanner.scan(t.as_py())] for t in batch], pa.list_(_KIND))

    return scan(text)


def license_blocks(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a confirmed block: the op6 query."""
    found = docs.where(col(text).isNotNull()).select(col(key).alias(key), F.explode(findings(col(text))).alias("f"))
    return found.select(key, F.col("f.start").alias("block_start"), F.col("f.end").alias("block_end"), "f.license", F.round("f.reduction", 6).alias("reduction"), "f.words", "f.matched", F.array_join("f.extra", " ").alias("extra"), F.array_join("f.missing", " ").alias("missing"), "f.exact")
