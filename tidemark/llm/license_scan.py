"""Licence scans over a positional index of rare licence words.

Templates are licence notices and whole licence texts. Their words are weighed by inverse
document frequency over the whole corpus. A file's licence words are looked up from the
rarest on, as long as a template could still be led to by them: a template's key phrases
stand in a file only if its two rarest key words do. The places of those words in the
file, each less its place in the template, are intersected; at each start on which they
agree the template's mandatory key phrases are verified word by word, and the score is
the part of the template's weight that stands in its place.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_arrow

#: Phrases that count wherever their words stand in a row, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Whole licence texts, as they are published, from the first word that does not change.
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of
source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA
OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB_TEXT = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment
in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software. 3. This notice may not be removed or altered from any source distribution."""
BOOST_TEXT = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the
"Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following
disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
machine-executable object code generated by a source language processor."""
UNLICENSE_TEXT = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs
and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along
with this program. If not, see"""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/."""

#: label, text of the template, mandatory key phrases within it, of two words at least.
TEMPLATES = (
    ("mit", MIT_TEXT, ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("bsd", BSD_TEXT, ("redistribution and use in source and binary forms", "following conditions are met")),
    ("isc", ISC_TEXT, ("for any purpose with or without fee is hereby granted",)),
    ("zlib", ZLIB_TEXT, ("this software is provided as is without any express or implied warranty", "must not be misrepresented")),
    ("bsl-1.0", BOOST_TEXT, ("permission is hereby granted free of charge", "machine executable object code")),
    ("unlicense", UNLICENSE_TEXT, ("unencumbered software released into the public domain",)),
    ("apache-2.0", APACHE_NOTICE, ("apache license version 2 0", "except in compliance with the license")),
    ("gpl", GPL_NOTICE, ("gnu general public license", "free software foundation")),
    ("mpl-2.0", MPL_NOTICE, ("mozilla public license v 2 0",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    ("gpl", "licensed under the gnu general public license version", ("gnu general public license",)),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee is hereby granted",)),
    ("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ("waived all copyright and related or neighboring rights",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international license",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0 international license",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
)

#: Of each template, the places of so many of its rarest key words are intersected.
ANCHORS = 4
#: Part of a template's weight that has to stand in its place, besides the key phrases.
MIN_COVER = 0.6

_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _words(text: str | None) -> list[bytes]:
    """Lower-cased words: digits, letters a-z and everything beyond ASCII."""
    # split() without an argument skips runs of the separator; no other ASCII white space is left by the translation
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


@dataclass
class Template:
    label: str
    words: list[bytes]
    phrases: list[tuple[int, list[bytes]]]  # place in the template, words
    anchors: list[tuple[bytes, int]]  # key words and their places, the rarest first
    weight: float


@dataclass
class LicenseIndex:
    """Templates by their rarest key word, and the weights of words."""

    idf: Mapping[bytes, float]
    by_rarest: dict[bytes, list[Template]] = field(default_factory=lambda: defaultdict(list))

    def __post_init__(self) -> None:
        rarer = lambda w: (-self.idf[w], w)
        for label, text, phrases in TEMPLATES:
            words = _words(text)
            keys = [(next(i for i in range(len(words)) if words[i : i + len(p)] == p), p) for p in map(_words, phrases)]
            places = sorted({(words[p + k], p + k) for p, phrase in keys for k in range(len(phrase))}, key=lambda a: (rarer(a[0]), a[1]))
            t = Template(label, words, keys, places[:ANCHORS], sum(self.idf[w] for w in words))
            self.by_rarest[places[0][0]].append(t)
        self.base = [(_words(p), label) for p, label in BASE_PHRASES.items()]
        self.wanted = {w for ts in self.by_rarest.values() for t in ts for w, _ in t.anchors} | {p[0] for p, _ in self.base}

    def starts(self, words: list[bytes], places: Mapping[bytes, list[int]]) -> Iterator[tuple[Template, int]]:
        """Templates and where each would start, by a file's licence words from the rarest on."""
        for w in sorted(places, key=lambda w: (-self.idf.get(w, 0.0), w)):
            for t in self.by_rarest.get(w, ()):
                agreed = {i - t.anchors[0][1] for i in places[w]}
                for other, p in t.anchors[1:]:
                    agreed &= {i - p for i in places.get(other, ())}
                    if not agreed:
                        break
                for start in sorted(agreed):
                    if all(start + p >= 0 and words[start + p : start + p + len(phrase)] == phrase for p, phrase in t.phrases):
                        yield t, start

    def scan(self, words: list[bytes]) -> tuple[int, int | None, int | None, set[str], set[str], float]:
        """n_base, first and last base place, base labels, all labels, score."""
        wanted, n = self.wanted, len(words)
        places: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in wanted:
                places.setdefault(w, []).append(i)
        found, base = [], set()
        for phrase, label in self.base:
            at = [i for i in places.get(phrase[0], ()) if words[i : i + len(phrase)] == phrase]
            found += at
            base |= {label} if at else set()
        labels, score = set(base), 1.0 if base else 0.0
        for t, start in self.starts(words, places):
            there = sum(self.idf[w] for k, w in enumerate(t.words) if 0 <= start + k < n and words[start + k] == w)
            cover = min(1.0, there / t.weight) if t.weight else 1.0
            if cover >= MIN_COVER:
                labels.add(t.label)
                score = max(score, cover)
        return len(found), min(found, default=None), max(found, default=None), base, labels, score


def template_words() -> list[bytes]:
    return sorted({w for _, text, _ in TEMPLATES for w in _words(text)})


def word_weights(docs: DataFrame, text: str = "text") -> dict[bytes, float]:
    """IDF of every template word over all of ``docs``. What reaches the driver is one row for each template word."""
    vocabulary = frozenset(template_words())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        n = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(vocabulary.intersection(_words(t)))
                n += 1
        rows = [*seen.items(), (b"", n)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.int64())], names=["word", "n"])

    counted = map_arrow(docs.select(text), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    by_word = {bytes(r.word): r.n for r in counted}
    n = by_word.get(b"", 0)
    return {w: math.log((1 + n) / (1 + by_word.get(w, 0))) + 1e-3 for w in vocabulary}


def scan_licenses(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``n_words, n_base, first_word, last_word, base_labels, labels, score`` to ``docs``.

    A null or empty text has no words, no labels ('') and the score 0. Overlapping phrases all
    count. Repeated rows are scanned each; columns of those names are replaced, all others stay.
    Two passes over the texts: weights over all of them, then the scan.
    """
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kept = docs.drop(*made)
    if not keep_text:
        kept = kept.drop(text)
    idf = word_weights(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LicenseIndex(idf)
        for batch in batches:
            found = []
            for t in batch.column(batch.schema.get_field_index("__text")).to_pylist():
                words = _words(t)
                n_base, first, last, base, labels, score = index.scan(words)
                found.append((len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            more = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            columns = [(f.name, c) for c, f in zip(batch.columns, batch.schema, strict=True) if f.name != "__text"]
            yield pa.RecordBatch.from_arrays([c for _, c in columns] + more, names=[x for x, _ in columns] + made)

    schema = StructType(list(kept.schema.fields))
    for name, kind in zip(made, ["long"] * 4 + ["string"] * 2 + ["double"], strict=True):
        schema = schema.add(name, kind)
    return map_arrow(docs.drop(*made).select(F.col(text).alias("__text"), *kept.columns), run, schema)
