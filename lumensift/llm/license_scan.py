r"""License scans by template-markup matching.

A template is a line of wording with markup: `<<beginOptional>> ... <<endOptional>>` encloses words that may be
missing, `<<var;max=N>>` stands for up to N words of any kind (names, years). Templates compile to token automata; a
text carries a license where an automaton accepts: the mandatory words stand exactly, in order and next to each other
but for optional and replaceable regions. A phrase without markup is a template of mandatory words only.

Scale: one streaming pass, no shuffle; templates are a fixed set inside the code that is shipped to the tasks. A cheap
necessary test (the template's longest mandatory word occurs) precedes every automaton run.

Defined results: null texts count as empty (0 words, no labels, score 0); very long texts are scanned whole; repeated
rows each get the same row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .per_document import map_documents, plain_words

BASE_PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

_O, _E = "<<beginOptional>>", "<<endOptional>>"
_NOTICE = f"{_O} Copyright <<var;max=24>> {_E}"
_AS_IS = """THIS SOFTWARE IS PROVIDED BY <<var;max=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;max=12>> BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = f"""{_NOTICE} {_O} All rights reserved. {_E} Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: {_O} 1 {_E} Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. {_O} 2 {_E} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_GPL = f"""{_O} This program is {_E} free software {_O} you can {_E} redistribute it and/or modify it under the terms of the GNU {{lesser}} General Public License
as published by the Free Software Foundation; either version {{n}} {_O} of the License {_E} {_O} , or (at your option) any later version {_E}"""
_CC = f"{_O} this work is {_E} licensed under {_O} a {_E} {_O} the {_E} {_O} terms of the {_E} Creative Commons Attribution"
_LEVEL = f"{_O} <<var;max=2>> {_E} {_O} International {_E} {_O} Unported {_E} License"

#: Wordings of public licences: the whole text where it is short, else the notice that the licence asks for.
TEMPLATES = [
    ("mit", f"""{_O} The {_E} {_O} MIT License {_E} {_O} (MIT) {_E} {_NOTICE} Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice {_O} (including the next paragraph) {_E} shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;max=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", f"{_O} released {_E} {_O} licensed {_E} {_O} distributed {_E} under the {_O} terms of the {_E} mit license"),
    ("isc", f"""{_NOTICE} Permission to use, copy, modify, and {_O} or {_E} distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;max=12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;max=12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-2-clause", f"{_BSD} {_AS_IS}"),
    ("bsd-3-clause", f"""{_BSD} {_O} 3 {_E} Neither the name of <<var;max=12>> nor the names of <<var;max=6>> contributors may be used to endorse or promote products derived from this
software without specific prior written permission. {_AS_IS}"""),
    ("apache-2", f"""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
<<var;max=8>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("apache-2", f"{_O} licensed {_E} under the {_O} terms of the {_E} apache license {_O} version {_E} 2 {_O} 0 {_E}"),
    *[(f"{short}gpl-{n}", _GPL.format(lesser=lesser, n=f"{n} {_O} 0 {_E}" if n != "2.1" else "2 1")) for short, lesser, numbers in (("", "", ("2", "3")), ("l", "Lesser", ("2.1", "3"))) for n in numbers],
    ("cc-by", f"{_CC} {_LEVEL}"),
    ("cc-by-sa", f"{_CC} ShareAlike {_LEVEL}"),
    ("cc-by-sa", f"{_CC} Share Alike {_LEVEL}"),
    ("cc-by-nc", f"{_CC} NonCommercial {_LEVEL}"),
    ("cc-by-nc-sa", f"{_CC} NonCommercial ShareAlike {_LEVEL}"),
    ("cc-by-nc-nd", f"{_CC} NonCommercial NoDerivatives {_LEVEL}"),
    ("cc-by-nc-sa", "cc by nc sa"),
    ("cc-by-nc-nd", "cc by nc nd"),
    ("copyright", f"copyright {_O} c {_E} <<var;max=8>> all rights reserved"),
    ("all-rights-reserved", "all rights reserved"),
]


class Automaton:
    """Nondeterministic automaton over words: states are places in the template, the last one accepts."""

    def __init__(self, template: str):
        template = template.replace("<<", " <<").replace(">>", ">> ")
        parts = re.findall(r"<<beginOptional>>|<<endOptional>>|<<var;max=\d+>>|[^<\s]+", template)
        self.step: list[dict] = [{}]  # word -> next state; None: any word
        self.skip: list[set[int]] = [set()]
        self.mandatory: list[bytes] = []
        open_at: list[int] = []
        for p in parts:
            here = len(self.step) - 1
            if p == "<<beginOptional>>":
                open_at.append(here)
            elif p == "<<endOptional>>":
                if not open_at:
                    raise ValueError(f"unmatched end of an optional region in {template!r}")
                self.skip[open_at.pop()].add(here)
            elif p.startswith("<<var"):
                n = int(re.search(r"\d+", p)[0])
                for k in range(n):
                    self._grow({None: here + k + 1})
                for k in range(n):
                    self.skip[here + k].add(here + n)
            else:
                for w in plain_words(p.encode()):
                    self._grow({w: len(self.step)})
                    if not open_at:
                        self.mandatory.append(w)
        if open_at or not self.mandatory:
            raise ValueError(f"template needs closed optional regions and a mandatory word: {template!r}")
        self.accept = len(self.step) - 1
        self.trigger = max(self.mandatory, key=len)
        self.start = self.closed({0})
        self.first = {w for s in self.start for w in self.step[s]}

    def _grow(self, edge: dict) -> None:
        self.step[-1] = edge
        self.step.append({})
        self.skip.append(set())

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def longest(self, words: list[bytes], i: int) -> int:
        """End of the longest acceptance that starts with word i, or -1."""
        states, end = self.start, -1
        while states and i < len(words):
            w, i = words[i], i + 1
            states = self.closed({e[k] for e in (self.step[s] for s in states) for k in (w, None) if k in e})
            if self.accept in states:
                end = i
        return end


def scan(words: list[bytes], automata: list[tuple[str, Automaton]], present: set[bytes] | None = None) -> list[tuple[str, int, int]]:
    """(label, first word, end) of the longest acceptance at each start."""
    present = set(words) if present is None else present
    found = []
    for label, a in automata:
        if a.trigger in present and all(w in present for w in a.mandatory):
            anything = None in a.first
            for i, w in enumerate(words):
                if (anything or w in a.first) and (end := a.longest(words, i)) >= 0:
                    found.append((label, i, end))
    return found


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Starts of every place where the phrase's words stand consecutively."""
    out, i, n = [], -1, len(phrase)
    while True:
        try:
            i = words.index(phrase[0], i + 1)
        except ValueError:
            return out
        if words[i : i + n] == phrase:
            out.append(i)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first_word:int,end_word:int>>"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Per row: n_words; n_base, first_word, last_word and base_labels of the base phrases; labels with those of the
    templates; matches (label and span in words); score: the share of the text's words that notices cover."""
    automata = [(k, Automaton(t)) for k, t in (TEMPLATES if templates is None else templates)]
    base = [(k, plain_words(p.encode())) for k, p in (BASE_PHRASES if phrases is None else phrases).items()]

    def one(doc_id, raw):
        w = plain_words(raw)
        present = set(w)
        hits = [(k, i, i + len(p)) for k, p in base if all(x in present for x in p) for i in places(w, p)]
        more = scan(w, automata, present)
        covered, reach = 0, 0
        for _, i, end in sorted(hits + more, key=lambda x: x[1:]):
            covered, reach = covered + max(0, end - max(i, reach)), max(reach, end)
        starts = [h[1] for h in hits]
        join = lambda found: ",".join(sorted({h[0] for h in found}))
        return doc_id, len(w), len(hits), min(starts, default=None), max(starts, default=None), join(hits), join(hits + more), covered / len(w) if w else 0.0, [{"label": k, "first_word": i, "end_word": e} for k, i, e in sorted(hits + more, key=lambda x: x[1:])]

    return map_documents(docs, {id_col: "value", text_col: "text"}, one, SCHEMA)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents")).drop("matches")
