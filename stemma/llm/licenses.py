"""Licence scan by a positional index of rare words.

A template is a licence text with mandatory key phrases that stand in it. The index posts, for every run of ``window`` words
of a template, the word of highest IDF in it (the rightmost of equal ones) under its position; document frequencies are those
of the whole corpus, and ``window`` is the length of the shortest phrase. A file picks its own words by the same rule, from
its runs of words that occur in templates, so a run that a file shares with a template picks the same word at the same
place. Each pick looks up its postings and votes for where the template would start; postings that agree on a start are
one proposal. At proposed starts the mandatory phrases are verified word by word. A label stands if all phrases of one of its
templates are verified at relative positions that are off by at most ``slack`` words, as some words may be added or left out
between them. The score is the largest share of a standing template's words that are found at the relative positions of its
verified phrases.

Scale: two scans without a shuffle of texts. The first sums document frequencies of the template words (a fixed
vocabulary of some hundred) with one row a batch; the second scans with the index, which is of the templates' size.

Defined cases: null and wordless texts have no places, empty labels and score 0; repeated rows are scanned each; of equally
rare words the later in the alphabet counts as rarer, also with an empty corpus; texts have any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stemma.llm import _text
from stemma.llm._spark import batch_of

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return _WORD.findall(self.text.lower())


#: Phrases whose places are counted, and their labels.
BASE = (Template("mit", "under the mit license", ("under the mit license",)), Template("apache-2", "apache license version 2", ("apache license version 2",)), Template("cc-by-nc", "cc by nc", ("cc by nc",)))

#: Parts that licence texts have in common.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_PERFORMANCE = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."


def _free(program: str, licence: str, version: str, warranty: str, see: str) -> str:
    """The notice that programs under the general public licences carry."""
    return (
        f"This {program} is free software: you can redistribute it and/or modify it under the terms of the {licence} as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version. This {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        f"without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {warranty} for more details. "
        f"You should have received a copy of the {see} along with this {program}."
    )


_GPL, _LGPL, _AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"

#: Texts of public licences, or the notices that stand for them in files, and what must stand in them.
TEMPLATES = (
    *BASE,
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
        ("permission is hereby granted free of charge", "to deal in the software without restriction", "this permission notice shall be included in all copies"),
    ),
    Template(
        "mit-0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. " + _AS_IS,
        ("permission is hereby granted free of charge", "to whom the software is furnished to do so the software is provided as is"),
    ),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _PERFORMANCE, ("modify and or distribute this software for any purpose", "this permission notice appear in all copies")),
    Template("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _PERFORMANCE, ("modify and or distribute this software for any purpose", "with or without fee is hereby granted the software is provided as is")),
    Template("bsd-2", _BSD + _BSD_AS_IS, ("redistribution and use in source and binary forms", "materials provided with the distribution this software is provided by")),
    Template("bsd-3", _BSD + _BSD_NAMES + _BSD_AS_IS, ("redistribution and use in source and binary forms", "may be used to endorse or promote products derived from this software")),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.", ("origin of this software must not be misrepresented", "altered source versions must be plainly marked as such")),
    Template("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:", ("covered by this license the software to use reproduce display distribute execute and transmit the software",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("free and unencumbered software released into the public domain",)),
    Template(
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("apache license version 2 0",),
    ),
    Template("gpl-3", _free("program", _GPL, "3", _GPL, _GPL), ("terms of the gnu general public license as published by the free software foundation", "either version 3 of the license")),
    Template("gpl-3", "This work is licensed under the GNU General Public License version 3", ("gnu general public license version 3",)),
    Template("gpl-2", _free("program", _GPL, "2", _GPL, _GPL), ("terms of the gnu general public license as published by the free software foundation", "either version 2 of the license")),
    Template("gpl-2", "This program is licensed under the GNU General Public License version 2", ("gnu general public license version 2",)),
    Template("lgpl-3", _free("library", _LGPL, "3", _LGPL, _LGPL), ("terms of the gnu lesser general public license as published by the free software foundation", "either version 3 of the license")),
    Template("lgpl-3", "Licensed under the GNU Lesser General Public License version 3", ("gnu lesser general public license version 3",)),
    Template("lgpl-2.1", _free("library", _LGPL, "2.1", _LGPL, _LGPL), ("terms of the gnu lesser general public license as published by the free software foundation", "either version 2 1 of the license")),
    Template("lgpl-2.1", "Licensed under the GNU Lesser General Public License version 2.1", ("gnu lesser general public license version 2 1",)),
    Template("agpl-3", _free("program", _AGPL, "3", _AGPL, _AGPL), ("terms of the gnu affero general public license as published by the free software foundation", "either version 3 of the license")),
    Template("agpl-3", "Licensed under the GNU Affero General Public License version 3", ("gnu affero general public license version 3",)),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ("mozilla public license v 2 0",)),
    Template("mpl-2", "Licensed under the Mozilla Public License, version 2.0", ("mozilla public license version 2 0",)),
    Template("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", ("eclipse public license 2 0",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international license",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0 international license",)),
    Template("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0", ("cc by nc sa",)),
    Template("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0", ("cc by nc nd",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
    Template("cc0", "CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0",)),
)


def slack(template: Template) -> int:
    """Words by which the phrases' relative positions may be off."""
    return max(10, len(template.words) // 4)


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


class Words:
    """Numbers of the template words in a text's hashes; -1 for others. Numbers rise with the IDF."""

    def __init__(self, names: list[str]):
        h = _text.hash_words([w.encode() for w in names])
        self.order = np.argsort(h)
        self.known = h[self.order]
        self.low = np.zeros(1 << 16, bool)
        self.low[(h & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        at = np.flatnonzero(self.low[(h & np.uint64(0xFFFF)).astype(np.int64)])
        k = np.searchsorted(self.known, h[at])
        k[k == len(self.known)] = 0
        same = self.known[k] == h[at]
        out[at[same]] = self.order[k[same]]
        return out


def frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """Texts that hold each template word."""
    names = vocabulary(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Words(names)
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            for a, b in _text.chunks(batch.column(0)):
                own, _, _, ranges = _text.words(*_text.buffers(batch.column(0).slice(a, b - a)), _text.ALNUM)
                k = number(own)
                at = np.flatnonzero(k >= 0)
                doc = np.searchsorted(ranges, at, "right") - 1
                total += np.bincount(np.unique(doc * len(names) + k[at]) % len(names), minlength=len(names))
        yield pa.RecordBatch.from_pydict({"word": pa.array(names), "n": pa.array(total)})

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {w: 0 for w in names} | {r["word"]: r["n"] for r in rows}


def picks(number: np.ndarray, ranges: np.ndarray, window: int) -> np.ndarray:
    """Places of the words of highest number, the rightmost of equal ones, in each run of ``window`` template words."""
    n = len(number) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    whole = np.ones(n, bool)
    for i in range(window):
        whole &= number[i : i + n] >= 0
    for i in range(1, window):  # not over the end of a text
        back = ranges[1:-1] - i
        whole[back[(back >= 0) & (back < n)]] = False
    at = np.flatnonzero(whole)
    best = at + window - 1
    for i in range(window - 2, -1, -1):
        best = np.where(number[at + i] > number[best], at + i, best)
    return np.unique(best)


@dataclass
class Index:
    templates: tuple[Template, ...]
    names: list[str]  # in order of IDF
    window: int
    #: Word number -> its postings are rows start[number] : start[number + 1] of template, position.
    start: np.ndarray
    template: np.ndarray
    position: np.ndarray
    texts: list[np.ndarray]  # word numbers
    phrases: list[list[tuple[int, int]]]  # first word and length of each phrase in its template


def build(counts: dict[str, int], templates: tuple[Template, ...] = TEMPLATES) -> Index:
    names = sorted(vocabulary(templates), key=lambda w: (-counts.get(w, 0), w))
    number = {w: i for i, w in enumerate(names)}
    texts = [np.array([number[w] for w in t.words]) for t in templates]
    phrases = []
    for t in templates:
        words, own = t.words, []
        for phrase in t.phrases:
            p = phrase.split()
            own.append((next(i for i in range(len(words)) if words[i : i + len(p)] == p), len(p)))
        phrases.append(own)
    window = min(n for own in phrases for _, n in own)
    posted = sorted((int(x[p]), t, int(p)) for t, x in enumerate(texts) for p in picks(x, np.array([0, len(x)]), window))
    word, template, position = (np.array(v, np.int64) for v in zip(*posted))
    return Index(templates, names, window, np.searchsorted(word, np.arange(len(names) + 1)), template, position, texts, phrases)


def proposals(index: Index, number: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Template and start of each proposal; a start may lie before the text."""
    at = picks(number, ranges, index.window)
    first, n = index.start[number[at]], np.diff(index.start)[number[at]]
    row = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
    both = np.unique(np.stack([index.template[row], np.repeat(at, n) - index.position[row]], 1), axis=0)
    return both[:, 0], both[:, 1]


_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def _standing(index: Index, t: int, places: list[set[int]], number: np.ndarray, lo: int, hi: int) -> float | None:
    """The score of a template in a text from lo to hi, None where it doesn't stand; places: verified starts by phrase."""
    off = slack(index.templates[t])
    every = sorted(set().union(*places))
    text = index.texts[t]
    best = None
    for d in places[0]:
        if not all(any(abs(x - d) <= off for x in own) for own in places):
            continue
        found = np.zeros(len(text), bool)
        for x in every:
            if abs(x - d) <= off:
                i, j = max(0, lo - x), min(len(text), hi - x)
                found[i:j] |= number[x + i : x + j] == text[i:j]
        best = max(best or 0.0, float(found.mean()))
    return best


def _scan(index: Index, base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Words(index.names)
        for batch in batches:
            texts = batch.column(1)
            for a, b in _text.chunks(texts):
                h, _, _, ranges = _text.words(*_text.buffers(texts.slice(a, b - a)), _text.ALNUM)
                number = numbers(h)
                template, begin = proposals(index, number, ranges)
                places: dict[int, dict[int, list[set[int]]]] = {}  # text -> template -> starts by phrase
                for t in np.unique(template).tolist():
                    for k, (offset, n) in enumerate(index.phrases[t]):
                        first = begin[template == t] + offset
                        first = first[(first >= 0) & (first + n <= len(number))]
                        for i in range(n):
                            first = first[number[first + i] == index.texts[t][offset + i]]
                        doc = np.searchsorted(ranges, first, "right") - 1
                        inside = first + n <= ranges[doc + 1]
                        for x, f in zip(doc[inside].tolist(), first[inside].tolist()):
                            places.setdefault(x, {}).setdefault(t, [set() for _ in index.phrases[t]])[k].add(f - offset)
                size = b - a
                n_base, first_word, last_word, base_labels, labels, score = [0] * size, [None] * size, [None] * size, [""] * size, [""] * size, [0.0] * size
                for x, found in places.items():
                    lo, hi = int(ranges[x]), int(ranges[x + 1])
                    counted = [d - lo for t in found if t < base for d in found[t][0]]
                    if counted:
                        n_base[x], first_word[x], last_word[x] = len(counted), min(counted), max(counted)
                    stands = {t: s for t, own in found.items() if (s := _standing(index, t, own, number, lo, hi)) is not None}
                    base_labels[x] = ",".join(sorted({index.templates[t].label for t in stands if t < base}))
                    labels[x] = ",".join(sorted({index.templates[t].label for t in stands}))
                    score[x] = max(stands.values(), default=0.0)
                yield batch_of(_FOUND, {"doc_id": batch.column(0).slice(a, size), "n_words": np.diff(ranges), "n_base": n_base, "first_word": first_word, "last_word": last_word, "base_labels": base_labels, "labels": labels, "score": score})

    return run


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: int = len(BASE)) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; the first ``base`` templates, of one phrase each, are counted."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = build(frequencies(own, templates), templates)
    return own.mapInArrow(_scan(index, base), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
