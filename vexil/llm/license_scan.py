"""License scans by template markup.

A template is license wording with <<beginOptional>> ... <<endOptional>> around what may be left out and
<<var;name=...;words=lo-hi>> where lo to hi words of anything may stand. Texts and templates are compared as words:
ASCII letters, folded, and digits; everything else separates. Each template is compiled to an automaton over words and
all of them to one, whose deterministic states are made as they are first reached. It runs from every word that may
start a template; of each template the longest match from there is taken, and the next one begins behind it. All words
outside optional and replaceable regions must match exactly.

A text can only match if it holds the rarest-looking mandatory word of some template, so one regular expression on the
JVM passes over the others before Python sees them. Defined results: a null text counts as empty; repeated rows are each
reported; matches of different templates may overlap and are all reported; other columns are ignored. Texts of any length
are read whole, each place once for every word that may start a template; an empty table gives no rows. A template must
have a mandatory word and may not begin with a replaceable region.

Templates of license texts and of file headers reach from the first to the last mandatory word, so that a text with another
disclaimer isn't taken for the license; those that end in "notice", and the one-line ones of Creative Commons, Eclipse and
reserved rights, name a license and claim no more.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



def optional(wording: str) -> str:
    return f"<<beginOptional>>{wording}<<endOptional>>"


def var(name: str, least: int, most: int) -> str:
    return f"<<var;name={name};words={least}-{most}>>"


COPYRIGHT = optional(f"Copyright {optional('(c)')} {var('holder', 1, 20)}") + " " + optional("All rights reserved.") + " "
BULLET = optional(var("bullet", 1, 1)) + " "
#: The disclaimer of most short licenses, up to what is sold or used.
NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE '
DEALINGS = "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    + BULLET + "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    + BULLET + "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
AS_IS = (
    f'THIS SOFTWARE IS PROVIDED BY {var("who", 1, 12)} "AS IS" AND ANY {optional("EXPRESS OR")} {optional("EXPRESSED OR")} IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    f"IN NO EVENT SHALL {var('who', 1, 12)} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
WORK_IS = optional(f"This {var('work', 1, 4)} is") + " "


def gnu(name: str, version: str) -> str:
    """The header of files under a license of that family, for this version or later."""
    return (
        f"is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. "
        f"{optional('This')} {var('work', 1, 6)} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
        + optional(f"You should have received a copy of the GNU {name} along with {var('work', 1, 6)} If not, see {optional('http')} {optional('https')} {optional('www')} gnu org licenses")
    )


def gnu_notice(name: str, version: str) -> str:
    return f"{WORK_IS} licensed under the {optional('terms of the')} GNU {name}, {optional('either')} version {version} {optional('of the License, or (at your option) any later version')}"


def commons(name: str) -> str:
    return f"{WORK_IS} licensed under {optional('a')} {optional('the')} {optional('Creative Commons')} {name} 4.0 {optional('International')} {optional('License')}"


#: License texts from their first to their last mandatory word, the headers that files carry, and one-line notices.
TEMPLATES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
    + var("place", 1, 12)
    + ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0-notice": optional("Licensed") + " under the Apache License, Version 2.0",
    "MIT": COPYRIGHT
    + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
    + optional("(including the next paragraph)")
    + " shall be included in all copies or substantial portions of the Software. "
    + NO_WARRANTY
    + f"AND NONINFRINGEMENT. IN NO EVENT SHALL {optional('THE')} {var('who', 1, 12)} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    + DEALINGS,
    "MIT-notice": WORK_IS + optional("Released") + " " + optional("Licensed") + " under the MIT License",
    "ISC": COPYRIGHT
    + f"Permission to use, copy, modify, and{optional('/or')} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    + f'THE SOFTWARE IS PROVIDED "AS IS" AND {var("who", 1, 12)} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {var("who", 1, 12)} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": COPYRIGHT + REDISTRIBUTION + AS_IS,
    "BSD-3-Clause": COPYRIGHT + REDISTRIBUTION + BULLET + f"Neither the name of {var('organization', 1, 12)} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + AS_IS,
    "BSL-1.0": optional("Boost Software License Version 1.0 August 17th, 2003")
    + ' Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. '
    + NO_WARRANTY
    + ", TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, "
    + DEALINGS,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will "
    + var("who", 1, 12)
    + " be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    + BULLET + "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    + BULLET + "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    + BULLET + "This notice may not be removed or altered from any source distribution.",
    "GPL-2.0-or-later": gnu("General Public License", "2"),
    "GPL-3.0-or-later": gnu("General Public License", "3"),
    "LGPL-2.1-or-later": gnu("Lesser General Public License", "2.1"),
    "LGPL-3.0-or-later": gnu("Lesser General Public License", "3"),
    "AGPL-3.0-or-later": gnu("Affero General Public License", "3"),
    "GPL-2.0-notice": gnu_notice("General Public License", "2"),
    "GPL-3.0-notice": gnu_notice("General Public License", "3"),
    "LGPL-3.0-notice": gnu_notice("Lesser General Public License", "3"),
    "AGPL-3.0-notice": gnu_notice("Affero General Public License", "3"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at " + var("place", 1, 8),
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License " + optional("v") + " 2.0",
    "CC-BY-4.0": commons("CC BY"),
    "CC-BY-4.0-spelled": commons("Attribution"),
    "CC-BY-SA-4.0": commons("CC BY SA"),
    "CC-BY-SA-4.0-spelled": commons("Attribution-ShareAlike"),
    "CC-BY-NC-4.0": commons("CC BY NC"),
    "CC-BY-NC-4.0-spelled": commons("Attribution-NonCommercial"),
    "CC0-1.0": f"To the extent possible under law, {var('who', 1, 20)} has waived all copyright and related or neighboring rights to {var('work', 1, 1)}",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    + NO_WARRANTY
    + "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    + DEALINGS,
    "rights-reserved": "All rights reserved",
}
MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")
WORD = re.compile(rb"[a-z0-9]+")


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


def parse(markup: str) -> list:
    """Nested items: a word, ("optional", items) or ("var", lo, hi)."""
    stack: list[list] = [[]]
    for i, part in enumerate(MARK.split(markup)):
        if i % 2 == 0:
            stack[-1] += words_of(part)
        elif part == "beginOptional":
            stack.append([])
        elif part == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            items = stack.pop()
            stack[-1].append(("optional", items))
        else:
            lo, hi = re.search(r"words=(\d+)-(\d+)", part).groups()
            stack[-1].append(("var", int(lo), int(hi)))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


def mandatory(items: list) -> list[bytes]:
    return [x for x in items if isinstance(x, bytes)]


def first_items(items: list) -> list:
    """What a match may begin with."""
    out = []
    for x in items:
        if isinstance(x, tuple) and x[0] == "optional":
            out += first_items(x[1])
            continue
        return [*out, x]
    return out


class Automaton:
    """All templates at once; matches(words) gives (template, start, end) in words."""

    MOST_STATES = 50_000

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.words: list[dict[bytes, list[int]]] = []
        self.any: list[list[int]] = []
        self.empty: list[list[int]] = []
        self.accepts: dict[int, str] = {}
        starts = []
        self.first: set[bytes] = set()
        for name, markup in templates.items():
            items = parse(markup)
            if not mandatory(items):
                raise ValueError(f"{name} has no mandatory word")
            heads = first_items(items)
            if not all(isinstance(x, bytes) for x in heads):
                raise ValueError(f"{name} begins with a replaceable region")
            self.first.update(heads)
            start = self._node()
            starts.append(start)
            self.accepts[self._add(items, start)] = name
        self.vocabulary = {w for node in self.words for w in node}
        self.start = self._closure(starts)
        self.table: dict[tuple[frozenset, bytes | None], frozenset] = {}

    def _node(self) -> int:
        self.words.append({})
        self.any.append([])
        self.empty.append([])
        return len(self.words) - 1

    def _add(self, items: list, at: int) -> int:
        for x in items:
            if isinstance(x, bytes):
                new = self._node()
                self.words[at].setdefault(x, []).append(new)
            elif x[0] == "optional":
                new = self._add(x[1], at_inner := self._node())
                self.empty[at] += [at_inner, new]
            else:
                _, lo, hi = x
                chain = [at]
                for _ in range(hi):
                    chain.append(self._node())
                    self.any[chain[-2]].append(chain[-1])
                new = self._node()
                for node in chain[lo:]:
                    self.empty[node].append(new)
            at = new
        return at

    def _closure(self, nodes) -> frozenset:
        seen, stack = set(nodes), list(nodes)
        while stack:
            for x in self.empty[stack.pop()]:
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        return frozenset(seen)

    def step(self, state: frozenset, word: bytes) -> frozenset:
        key = (state, word if word in self.vocabulary else None)
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= self.MOST_STATES:
                self.table.clear()
            known = self.table[key] = self._closure([x for node in state for x in (*self.words[node].get(word, ()), *self.any[node])])
        return known

    def matches(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        out, done = [], dict.fromkeys(self.accepts.values(), 0)
        for i, word in enumerate(words):
            if word not in self.first:
                continue
            state, j, longest = self.start, i, {}
            while state and j < len(words):
                state = self.step(state, words[j])
                j += 1
                for node in state & self.accepts.keys():
                    longest[self.accepts[node]] = j
            for name, end in longest.items():
                if i >= done[name]:
                    out.append((name, i, end))
                    done[name] = end
        return out


def prefilter(templates: dict[str, str] = TEMPLATES) -> str:
    """One mandatory word of each template, the longest, to be looked for in small letters. What another one of them is part of is left out."""
    picked = {max(mandatory(parse(t)), key=lambda w: (len(w), w)).decode() for t in templates.values()}
    return "|".join(sorted(w for w in picked if not any(v != w and v in w for v in picked)))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, license_id, start_word, end_word) of each match; end_word lies beyond the last."""
    maybe = docs.select("doc_id", "text").where(F.lower("text").rlike(prefilter(templates)))
    schema = T.StructType([maybe.schema["doc_id"], T.StructField("license_id", T.StringType()), T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType())])

    def run(batches):
        automaton = Automaton(templates)
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = automaton.matches(words_of(text))
                rows += [i] * len(own)
                found += own
            columns = list(zip(*found)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], schema.names)

    return maybe.mapInArrow(run, schema)


def pattern(items: list) -> str:
    """The template as a regular expression over words that each have one space behind."""
    out = ""
    for x in items:
        out += f"{x.decode()} " if isinstance(x, bytes) else f"(?:{pattern(x[1])})?" if x[0] == "optional" else f"(?:[a-z0-9]+ ){{{x[1]},{x[2]}}}"
    return out


def _sql() -> str:
    parts = "\nUNION ALL ".join(
        f"SELECT doc_id, '{name}' AS license_id, regexp_extract_all(t, '\\b(?:{pattern(parse(t))})') AS found, string_split(regexp_replace(t, '\\b(?:{pattern(parse(t))})', '|', 'g'), '|') AS gaps FROM plain" for name, t in TEMPLATES.items()
    )
    return f"""
WITH plain AS (
  SELECT doc_id, trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents
), raw AS ({parts}
), each AS (
  SELECT doc_id, license_id, i, length(found[i]) - length(replace(found[i], ' ', '')) AS n, length(gaps[i]) - length(replace(gaps[i], ' ', '')) AS gap
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM raw WHERE len(found) > 0)
), placed AS (
  SELECT *, sum(n + gap) OVER (PARTITION BY doc_id, license_id ORDER BY i) AS reach FROM each
)
SELECT doc_id, license_id, (reach - n)::BIGINT AS start_word, reach::BIGINT AS end_word FROM placed
"""


SQL = _sql()
