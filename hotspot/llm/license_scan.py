"""Licence scan: units of a text against licence templates, by Dice coefficient over word bigrams.

A unit is a line, a paragraph of several lines, a sentence of a paragraph that has several, or a text
of several paragraphs. Whole licences are templates paragraph by paragraph, so that they are found inside
longer texts, wrapped or commented in any way. A template of n bigrams can reach the threshold t only on units of n * t / (2 - t) to n * (2 - t) / t bigrams,
and only if one of its rarest bigrams is there; all other pairs are passed over unseen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspot.llm.common import by_value

by_value(__name__)

THRESHOLD = 0.8
# fixed values: short public notices
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Released under the 3-clause BSD License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
# fixed values: paragraphs and clauses of public licences and of the file headers that they ask for
PARAGRAPHS = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("Apache-2.0", "See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-2-Clause", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)


_WORD = re.compile("[a-z0-9]+")
# a sentence ends before white space, any signs and a capital letter; no sign of an end is passed over
_END = r"([.!?:])[ \t\r][^A-Za-z0-9.!?:]*([A-Z])"
_SENTENCE = re.compile(_END)


def sentences(paragraph: str) -> list[str]:
    """Sentences of a text in one line."""
    return _SENTENCE.sub(r"\1\n\2", paragraph).split("\n")


def with_sentences(templates: Sequence[tuple[str, str]]) -> tuple[tuple[str, str], ...]:
    """The templates, then the sentences of those that have several: a comment without blank lines is
    one paragraph, in which only sentences can be told apart."""
    return (*templates, *((name, part) for name, text in templates if len(parts := sentences(text)) > 1 for part in parts))


#: What is looked for unless the caller gives templates.
TEMPLATES = with_sentences((*NOTICES, *PARAGRAPHS))


def normalise(text: str) -> list[str]:
    """Words of ASCII letters and digits, lower-cased; everything else parts words."""
    return _WORD.findall(text.lower())


def bigrams(words: Sequence[str]) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    """2 * shared / (all of a + all of b), counting repeats."""
    total = a.total() + b.total()
    return 2 * sum(min(n, b[g]) for g, n in a.items() if g in b) / total if total else 0.0


class Templates:
    """Templates with their size bounds, indexed by the bigrams that a match cannot do without."""

    def __init__(self, templates: Sequence[tuple[str, str]], threshold: float) -> None:
        self.threshold = threshold
        self.rows = []
        self.index: dict[tuple[str, str], list[int]] = {}
        df = Counter(g for _, t in templates for g in set(bigrams(normalise(t))))
        for name, text in templates:
            grams = bigrams(normalise(text))
            n = grams.total()
            if not n:
                continue
            lo, hi = math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)
            k = len(self.rows)
            self.rows.append((name, grams, n, lo, hi))
            # a match shares lo bigrams at least: some n - lo + 1 occurrences cannot all be missing
            left = n - lo + 1
            for g, c in sorted(grams.items(), key=lambda x: (df[x[0]], -len(x[0][0]) - len(x[0][1]), x[0])):
                if left <= 0:
                    break
                self.index.setdefault(g, []).append(k)
                left -= c
        self.lo = min((r[3] for r in self.rows), default=1)
        self.hi = max((r[4] for r in self.rows), default=0)
        self.keys = sorted({max(g, key=len) for g in self.index})
        self.any = re.compile("|".join(map(re.escape, self.keys)) or "(?!)")

    def may_match(self, words: list[str]) -> bool:
        """Whether any part of these successive words can match: it needs an indexed bigram."""
        return not self.index.keys().isdisjoint(zip(words, words[1:]))

    def best(self, words: list[str]) -> tuple[str, float] | None:
        """The template of highest coefficient at or above the threshold, the first by name among equals."""
        n = len(words) - 1
        if not self.lo <= n <= self.hi:
            return None
        grams = bigrams(words)
        tried = {k for g in grams if g in self.index for k in self.index[g]}
        found = [(-dice(grams, self.rows[k][1]), self.rows[k][0]) for k in tried if self.rows[k][3] <= n <= self.rows[k][4]]
        found = [f for f in found if -f[0] >= self.threshold - 1e-12]
        return (min(found)[1], -min(found)[0]) if found else None


def units(text: str) -> Iterator[tuple[str, int, int, int, str]]:
    """``(kind, first line, number of lines, part, text)`` of the lines, then paragraphs of several lines that
    blank lines part, sentences of paragraphs that have several, but for those that are the words of a line (``part``, from 0, is the
    sentence's number; the lines are those of its paragraph), then the whole of a text of several lines that blank lines part."""
    lines = text.split("\n")
    for i, line in enumerate(lines):
        yield "line", i, 1, 0, line
    first, paragraphs = None, 0
    for i, line in enumerate([*lines, ""]):
        if line.strip(" \t\r"):
            first = i if first is None else first
        elif first is not None:
            paragraphs += 1
            whole = " ".join(lines[first:i])
            if i - first > 1:
                yield "paragraph", first, i - first, 0, whole
            parts = sentences(whole)
            if len(parts) > 1:
                seen = {" ".join(normalise(x)) for x in lines[first:i]}
                yield from (("sentence", first, i - first, k, part) for k, part in enumerate(parts) if " ".join(normalise(part)) not in seen)
            first = None
    if paragraphs > 1:
        yield "text", 0, len(lines), 0, text


def _scanner(templates: Sequence[tuple[str, str]], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text or not known.may_match(normalise(text)):
                    continue
                for kind, first, n, part, words in units(text):
                    if known.any.search(words.lower()) and (hit := known.best(normalise(words))):
                        out.append((i, kind, first, n, part, *hit))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["doc_id", "unit", "first_line", "n_lines", "part", "license", "dice"])

    return run


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence notices in whole texts: ``(doc_id, unit, first_line, n_lines, part, license, dice)``.

    One row per unit (line, paragraph of several lines, sentence of a paragraph of several
    that is no line by itself, text of several paragraphs) whose best template reaches the threshold;
    ``templates`` are ``(licence, text)`` of any number; equal coefficients go to the first licence by name. Null and
    empty texts have none. Rows without an id and repeated rows are scanned each for itself; an
    empty table gives an empty result; other columns are ignored. Nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scanner(tuple(templates), threshold), "doc_id long, unit string, first_line long, n_lines long, part long, license string, dice double")


def oracle_sql(templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The scan in DuckDB, every unit against every template."""
    values = ", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in templates)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS k, name, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM (VALUES {values}) v(name, text)),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
b AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) = '' AS blank FROM l),
p AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM b),
pa AS (SELECT doc_id, min(i) AS i, count(*) AS n, string_agg(line, ' ' ORDER BY i) AS line, list(trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g'))) AS own FROM p WHERE NOT blank GROUP BY doc_id, part),
se AS (SELECT doc_id, i, n, own, string_split(regexp_replace(line, '{_END}', '\1' || chr(10) || '\2', 'g'), chr(10)) AS parts FROM pa),
u AS (SELECT doc_id, 'line' AS unit, i, 1 AS n, 0 AS part, line FROM l
      UNION ALL SELECT doc_id, 'paragraph', i, n, 0, line FROM pa WHERE n > 1
      UNION ALL SELECT doc_id, 'sentence', i, n, part, line FROM (SELECT doc_id, i, n, own, unnest(range(len(parts))) AS part, unnest(parts) AS line FROM se WHERE len(parts) > 1) WHERE NOT list_contains(own, trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')))
      UNION ALL SELECT doc_id, 'text', 0, len(string_split(text, chr(10))), 0, text FROM documents WHERE doc_id IN (SELECT doc_id FROM pa GROUP BY doc_id HAVING count(*) > 1)),
d AS (SELECT *, string_split(trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM u),
tg AS (SELECT k, g, count(*) AS c FROM (SELECT k, unnest(list_transform(range(1, len(w)), lambda x: w[x] || ' ' || w[x + 1])) AS g FROM t) GROUP BY ALL),
dg AS (SELECT doc_id, unit, i, part, g, count(*) AS c FROM (SELECT doc_id, unit, i, part, unnest(list_transform(range(1, len(w)), lambda x: w[x] || ' ' || w[x + 1])) AS g FROM d) GROUP BY ALL),
s AS (SELECT doc_id, unit, i, part, k, sum(least(dg.c, tg.c)) AS shared FROM dg JOIN tg USING (g) GROUP BY ALL),
c AS (SELECT d.doc_id, d.unit, d.i, d.n, d.part, t.name, 2.0::DOUBLE * shared / ((len(d.w) - 1) + (len(t.w) - 1)) AS dice
      FROM s JOIN t USING (k) JOIN d ON d.doc_id = s.doc_id AND d.i = s.i AND d.unit = s.unit AND d.part = s.part)
SELECT doc_id, unit, i::BIGINT AS first_line, n::BIGINT AS n_lines, part::BIGINT AS part, name AS license, dice
FROM c WHERE dice >= {threshold} - 1e-12
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, i, part ORDER BY dice DESC, name) = 1
"""
