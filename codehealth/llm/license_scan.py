"""License scanning with templates compiled to token automata.

A template is license wording with marked regions: optional ones may be there or not,
replaceable ones stand for other words. It is compiled to a nondeterministic automaton
over words; a run of words is accepted if the mandatory wording matches word by word.
Plain phrases are counted beside it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehealth.llm.common import pieces, utf8, words

#: Fixed by the query's contract: phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# The wording of public licences.
DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<var;words="1-16">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
    IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;words="1-16">> BE LIABLE FOR
    ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
    OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
    LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
    SUCH DAMAGE."""
CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
    are met: <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the
    following disclaimer. <<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of
    conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

#: License wording as templates: whole licences, or (named notice, and those of GPL, LGPL, MPL,
#: Apache and CC, whose texts are documents of their own) the notice that puts a work under one. <<beginOptional>>...<<endOptional>> may be left out;
#: <<var;words="a-b">> stands for a to b words of any kind, <<var;match="regex">> for one word.
TEMPLATES = {
    "MIT-notice": '<<beginOptional>>released <<beginOptional>>or distributed<<endOptional>> under<<endOptional>> the MIT license',
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of
        <<var;words="1-8">> and associated documentation files <<beginOptional>>(the "Software")<<endOptional>>, to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial
        portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL <<var;words="1-16">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
        THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, <<beginOptional>>and/or<<endOptional>> <<beginOptional>>and<<endOptional>> distribute this software for any purpose with
        or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in
        all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;words="1-16">> DISCLAIMS ALL WARRANTIES WITH REGARD TO
        THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
        <<var;words="1-16">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": f"{CONDITIONS} {DISCLAIMER}",
    "BSD-3-Clause": f"""{CONDITIONS} <<beginOptional>>3<<endOptional>> Neither the name of <<var;words="1-16">> nor the names of its contributors may
        be used to endorse or promote products derived from this software without specific prior written permission. {DISCLAIMER}""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: <<beginOptional>>1<<endOptional>> The origin
        of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
        acknowledgment in the product documentation would be appreciated but is not required. <<beginOptional>>2<<endOptional>> Altered source versions
        must be plainly marked as such, and must not be misrepresented as being the original software. <<beginOptional>>3<<endOptional>> This notice
        may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare
        derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The
        copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer,
        must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative
        works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS",
        WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR
        OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
        THE SOFTWARE.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at <<beginOptional>>http<<endOptional>><<beginOptional>>https<<endOptional>> mozilla.org/MPL/2.0""",
    "LGPL-2.1": 'GNU lesser general public license<<beginOptional>> as published by <<var;words="1-6">> either<<endOptional>> version 2.1 <<beginOptional>>of the license<<endOptional>> <<beginOptional>>or (at your option) any later version<<endOptional>>',
    "LGPL-3.0": 'GNU lesser general public license<<beginOptional>> as published by <<var;words="1-6">> either<<endOptional>> version 3<<beginOptional>>.0<<endOptional>> <<beginOptional>>of the license<<endOptional>> <<beginOptional>>or (at your option) any later version<<endOptional>>',
    "Apache-2.0": """licensed under the Apache license, version 2.0 <<beginOptional>>(the "License"); you may not use
        <<var;words="1-4">> except in compliance with the License<<endOptional>>""",
    "GPL-2.0": 'GNU general public license<<beginOptional>> as published by <<var;words="1-6">> either<<endOptional>> version 2<<beginOptional>>.0<<endOptional>> <<beginOptional>>of the license<<endOptional>> <<beginOptional>>or (at your option) any later version<<endOptional>>',
    "GPL-3.0": 'GNU general public license<<beginOptional>> as published by <<var;words="1-6">> either<<endOptional>> version 3<<beginOptional>>.0<<endOptional>> <<beginOptional>>of the license<<endOptional>> <<beginOptional>>or (at your option) any later version<<endOptional>>',
    "CC-BY": '<<beginOptional>>licensed under <<beginOptional>>a<<endOptional>><<endOptional>> CC BY <<var;match="[1-4]">> <<var;match="[05]">>',
    "CC-BY-SA": '<<beginOptional>>licensed under <<beginOptional>>a<<endOptional>><<endOptional>> CC BY SA <<var;match="[1-4]">> <<var;match="[05]">>',
    "CC-BY-NC": '<<beginOptional>>licensed under <<beginOptional>>a<<endOptional>><<endOptional>> CC BY NC <<var;match="[1-4]">> <<var;match="[05]">>',
}

MARK = re.compile(r'<<(beginOptional|endOptional|var)((?:;\w+="[^"]*")*)>>')


def parsed(template: str) -> list:
    """The template as a tree: words, ("any", low, high), ("match", regex) and lists, which are optional."""
    stack, at = [[]], 0
    for m in MARK.finditer(template):
        stack[-1] += [w.decode() for w in words(template[at : m.start()].encode())]
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) < 2:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            stack[-1].append(inner)
        else:
            given = dict(re.findall(r';(\w+)="([^"]*)"', m[2]))
            if "match" in given:
                stack[-1].append(("match", given["match"]))
            else:
                low, high = map(int, given.get("words", "0-8").split("-"))
                stack[-1].append(("any", low, high))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0] + [w.decode() for w in words(template[at:].encode())]


@dataclass
class Automaton:
    """States are numbers; 0 starts, ``last`` accepts. Moves by word, by test, and without a word."""

    label: str
    by_word: dict[int, dict[bytes, int]] = field(default_factory=lambda: defaultdict(dict))
    by_test: dict[int, list[tuple[re.Pattern | None, int]]] = field(default_factory=lambda: defaultdict(list))
    free: dict[int, list[int]] = field(default_factory=lambda: defaultdict(list))
    last: int = 0
    #: The most words of an accepted run, and a word that every accepted run has.
    longest: int = 0
    needed: bytes | None = None

    def new(self) -> int:
        self.last += 1
        return self.last

    def add(self, tree: list) -> None:
        for part in tree:
            at = self.last
            if isinstance(part, str):
                self.by_word[at][part.encode()] = self.new()
                self.longest += 1
            elif isinstance(part, list):
                begin = self.new()
                self.free[at].append(begin)
                self.add(part)
                inner = self.last
                end = self.new()
                self.free[inner].append(end)
                self.free[at].append(end)
            elif part[0] == "match":
                self.by_test[at].append((re.compile(part[1].encode()), self.new()))
                self.longest += 1
            else:
                states = [at]
                for _ in range(part[2]):
                    self.by_test[self.last].append((None, self.new()))
                    states.append(self.last)
                end = self.new()
                for s in states[part[1] :]:
                    self.free[s].append(end)
                self.longest += part[2]

    def spread(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.free.get(todo.pop(), ()):
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def accepts(self, found: list[bytes], start: int) -> int:
        """Words of the longest accepted run that starts at ``start``; 0 if there is none."""
        states, best, n = self.spread({0}), 0, 0
        for w in found[start : start + self.longest]:
            n += 1
            states = {self.by_word[s][w] for s in states if s in self.by_word and w in self.by_word[s]} | {
                t for s in states for test, t in self.by_test.get(s, ()) if test is None or test.fullmatch(w)
            }
            if not states:
                break
            states = self.spread(states)
            if self.last in states:
                best = n
        return best


def compiled(label: str, template: str) -> Automaton:
    tree = parsed(template)
    mandatory = [p for p in tree if isinstance(p, str)]
    if not mandatory:
        raise ValueError(f"{label}: a template needs a mandatory word")
    out = Automaton(label)
    out.add(tree)
    out.needed = max(mandatory, key=len).encode()
    return out


class Scanner:
    """Phrases and templates over the words of a text."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [([w for w in words(p.encode())], label) for p, label in phrases.items()]
        self.automata = [compiled(label, t) for label, t in templates.items()]
        self.needed = {max(p, key=len) for p, _ in self.phrases} | {a.needed for a in self.automata}
        self.ahead = max([1, *(len(p) for p, _ in self.phrases), *(a.longest for a in self.automata)])
        self.by_first: dict[bytes, list[Automaton]] = defaultdict(list)
        self.open: list[Automaton] = []
        for a in self.automata:
            start = a.spread({0})
            if any(s in a.by_test for s in start):
                self.open.append(a)
            for w in {w for s in start for w in a.by_word.get(s, ())}:
                self.by_first[w].append(a)

    def scan(self, data: bytes) -> dict:
        """n_words, base places, base and template labels, and the accepted runs (label, first word, words)."""
        n, places, base, runs = 0, [], set(), []
        parts, kept = pieces(data), []
        for k, part in enumerate(parts):
            found = kept + part.split()
            ends = k == len(parts) - 1
            starts = len(found) if ends else max(0, len(found) - self.ahead)
            if not self.needed.isdisjoint(found):
                firsts = {p[0] for p, _ in self.phrases} | self.by_first.keys()
                for i in range(starts):
                    w = found[i]
                    if w in firsts or self.open:
                        for p, label in self.phrases:
                            if w == p[0] and found[i : i + len(p)] == p:
                                places.append(n + i)
                                base.add(label)
                        for a in [*self.by_first.get(w, ()), *self.open]:
                            if size := a.accepts(found, i):
                                runs.append((a.label, n + i, size))
            n += starts
            kept = found[starts:]
        return {"n_words": n, "places": places, "base": base, "runs": runs}


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict = PHRASES, templates: dict = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score, runs.

    ``runs`` lists the accepted runs (label, first word, number of words; the longest from
    each start). ``score``: 1 if a template accepts a run, 0.5 if only a phrase stands
    there, else 0. Null and empty texts have no words and score 0; repeated rows give
    repeated rows; other columns are ignored; texts are read in pieces, whatever their size.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            rows = [scanner.scan(x.as_py()) for x in batch.column(1)]
            columns = [
                pa.array([r["n_words"] for r in rows], pa.int64()),
                pa.array([len(r["places"]) for r in rows], pa.int64()),
                pa.array([min(r["places"], default=None) for r in rows], pa.int64()),
                pa.array([max(r["places"], default=None) for r in rows], pa.int64()),
                pa.array([",".join(sorted(r["base"])) for r in rows], pa.string()),
                pa.array([",".join(sorted(r["base"] | {x[0] for x in r["runs"]})) for r in rows], pa.string()),
                pa.array([1.0 if r["runs"] else 0.5 if r["places"] else 0.0 for r in rows], pa.float64()),
                pa.array([[{"label": a, "first_word": i, "n_words": k} for a, i, k in r["runs"]] for r in rows], run_type),
            ]
            names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "runs"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, runs array<struct<label:string,first_word:long,n_words:long>>"
    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("data"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
