from __future__ import annotations

import random

from agreemill.llm import licenses
from agreemill.llm.licenses import TEMPLATES, Scanner

SCHEMA = "doc_id long, text string, license string"


def prose(rng, n):
    return " ".join("".join(rng.choices(["er", "on", "th", "in", "ar"], k=rng.randint(1, 4))) for _ in range(n)) + "."


def corpus():
    rng = random.Random(3)
    rows, truth = [], {}
    for i, (name, text) in enumerate(sorted(TEMPLATES.items()) * 3):
        sentences = text.split(". ")
        block = ". ".join(sentences[rng.randrange(len(sentences)) :]) if i % 3 == 1 else text
        words = block.split(" ")
        if i % 3 == 2:
            for _ in range(len(words) // 30):
                words[rng.randrange(len(words))] = "changed"
        rows.append((i, f"{prose(rng, 40)}\n{' '.join(words)}\n{prose(rng, 300)}", "x"))
        truth[i] = name
    return rows, truth


def exhaustive(text):
    """Every template is aligned with every block; no compression."""
    s = Scanner()
    out = []
    for start, end in s.blocks(text or ""):
        spans = [(start, end)]
        if not fits(s, text[start:end]):
            spans = [m.span() for m in licenses._unit.finditer(text, start, end) if s.like(licenses.normal(m[0]))]
        for a, b in spans:
            a += len(text[a:b]) - len(text[a:b].lstrip())
            if fits(s, text[a:b]):
                out.append((a, b, fits(s, text[a:b])))
    return out


def fits(s, block):
    """The most words that any template matches, if they are enough."""
    tried = [s.confirm(block, i)[:2] for i in range(len(s.names))]
    return max((m for words, m in tried if (words >= 4 or "SPDX" in block) and m >= 0.8 * words), default=0)


def test_known_wordings_are_found(spark):
    rows, truth = corpus()
    got = licenses.license_blocks(spark.createDataFrame(rows, SCHEMA)).collect()
    whole = [r for r in got if r["doc_id"] % 3 == 0]
    assert {r["doc_id"]: r["license"] for r in whole} == {i: n for i, n in truth.items() if i % 3 == 0}
    assert all(r["exact"] and r["reduction"] > 0.5 for r in whole)
    edited = {r["doc_id"]: r["license"] for r in got if r["doc_id"] % 3 == 2}
    assert edited == {i: n for i, n in truth.items() if i % 3 == 2}


def test_ranking_loses_no_block_of_an_exhaustive_search(spark):
    rows, _ = corpus()
    got = licenses.license_blocks(spark.createDataFrame(rows, SCHEMA)).collect()
    expected = {(i, *b) for i, t, _ in rows for b in exhaustive(t)}
    assert {(r["doc_id"], r["block_start"], r["block_end"], r["matched"]) for r in got} == expected


def test_wording_differences_are_exact():
    f = Scanner().scan("Intro text here.\nLicensed under the Apache License, Version 1.1.\nTail words.")[0]
    assert (f.license, f.extra, f.missing, f.exact) == ("Apache-2.0", ["1.1"], [], False)
    assert Scanner().scan("Released under the MIT License.")[0].exact


def test_prose_about_licenses_is_left_alone():
    assert Scanner().scan("He lost his driving license on a rainy night, and nobody at the office cared much.") == []
    assert Scanner().scan("license") == []


def paragraphs():
    for name, text in licenses.templates():
        for p in text.split("\n\n"):
            if len(licenses.normal(p)) >= 8:
                yield name, p


def test_every_paragraph_of_every_template_is_found_alone():
    s = Scanner()
    for name, p in paragraphs():
        found = s.scan(f"Some words of our own before it.\n{p}\nAnd xyzzy plugh after it.")
        words = sum(f.words for f in found)
        holders = {s.names[i] for i in range(len(s.names)) if s.confirm(p, i)[1] == len(licenses.normal(p))}
        assert found and {f.license for f in found} <= holders | {name}, (name, p)
        assert words >= 0.8 * len(licenses.normal(p)) - 3, (name, p)  # a number or title word before it may stay out


def test_whole_license_texts_are_one_block():
    """A license with a word changed here and there, inside other text, is not cut."""
    s = Scanner()
    for name, text in licenses.templates():
        words = len(licenses.normal(text))
        if words > 1000:
            edited = text.replace(" the ", " our ", 3)
            found = s.scan(f"Our own words come first.\n\n{edited}\n\nOur own words come last.")
            assert sum(f.words for f in found if f.license == name) >= 0.97 * words, name
            assert max(f.words for f in found) >= 0.9 * words, (name, [f.words for f in found])


def test_a_sentence_without_cue_words():
    found = Scanner().scan("Hello.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary.\nBye.")
    assert [f.license for f in found] == ["Unlicense"]


def test_spdx_tags_alone():
    assert [f.license for f in Scanner().scan("# SPDX-License-Identifier: MIT\nimport x\n")] == ["MIT"]


def test_long_blocks_are_cut_and_kept(spark):
    text = "Licensed under CC BY-NC 4.0. " * 3000
    found = Scanner().scan(text)
    assert len(found) == 3000 and sum(f.words for f in found) == len(licenses.normal(text))
    assert {f.license for f in found} == {"CC-BY-NC-4.0"} and all(f.exact for f in found)


def test_edges(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no cue", ""), (4, "Released under the MIT License.", ""), (4, "Released under the MIT License.", "")]
    got = licenses.license_blocks(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["doc_id"], r["license"], r["block_start"], r["block_end"]) for r in got] == [(4, "MIT", 0, 31)] * 2
    assert licenses.license_blocks(spark.createDataFrame([], SCHEMA)).collect() == []


GNU = """This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details.

You should have received a copy of the GNU {1} along with this {0}. If not, see <https://www.gnu.org/licenses/>."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def test_full_notices_are_one_block_of_the_right_name():
    full = {"BSD-3-Clause": BSD, "ISC": ISC, "GPL-3.0-or-later": GNU.format("program", "General Public License"), "AGPL-3.0-or-later": GNU.format("program", "Affero General Public License"), "LGPL-3.0-or-later": GNU.format("library", "Lesser General Public License")}
    full["GPL-2.0-or-later"] = full["GPL-3.0-or-later"].replace("software:", "software;").replace("Foundation,", "Foundation;").replace("version 3", "version 2").replace(". If not, see <https://www.gnu.org/licenses/>.", "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.")
    for name, text in full.items():
        found = Scanner().scan(text)
        assert [(f.license, f.exact, f.words) for f in found] == [(name, True, len(licenses.normal(text)))], name


def test_shorter_wordings_are_not_taken_for_longer_ones():
    """A notice that is part of another one has its own name."""
    scanner = licenses.Scanner()
    bsd2 = BSD[: BSD.index("3. Neither")] + BSD[BSD.index("THIS SOFTWARE IS PROVIDED") :]
    only = GNU.format("program", "General Public License")
    start, end = only.index("the GNU General Public License as published"), only.index("any later version.") + len("any later version.")
    only = only[:start] + "the GNU General Public License version 3 as published by the Free Software Foundation." + only[end:]
    for text, name in ((bsd2, "BSD-2-Clause"), (BSD, "BSD-3-Clause"), (only, "GPL-3.0-only"), (GNU.format("program", "General Public License"), "GPL-3.0-or-later"), ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0-only")):
        assert {f.license for f in scanner.scan(text)} == {name}, name


def test_search_ends_at_the_first_exact_template(monkeypatch):
    scanner, tried = licenses.Scanner(), []
    real = licenses.Scanner.confirm
    monkeypatch.setattr(licenses.Scanner, "confirm", lambda self, block, i: tried.append(i) or real(self, block, i))
    whole = dict(licenses.templates())["ISC"]
    found = scanner.judge(whole)
    assert found.license == "ISC" and found.exact and len(tried) == 1


def test_wordings_inside_long_lines_without_stops():
    """A grant in the middle of running words is found, with its place."""
    grant = dict(licenses.templates())["MIT"].split("MIT License. ")[-1].split(":")[0]
    words = " ".join(f"w{i} and so" for i in range(80))
    text = f"{words} {grant} {words}"
    found = licenses.Scanner().scan(text)
    assert [(f.license, text[f.start : f.end]) for f in found] == [("MIT", grant)]
    assert not licenses.Scanner().scan(words)
    two = f"{words} {grant} {words} {grant}"
    assert [f.license for f in licenses.Scanner().scan(two)] == ["MIT", "MIT"]
