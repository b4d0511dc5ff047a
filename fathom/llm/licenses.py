"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Text is cut to lower-case ASCII letters and digits; all else separates words. Compared are the whole text, its
paragraphs (between blank lines) and its lines, each by its set of word bigrams, and windows: for a template of n words,
every run of n words (fewer at the text's end) that begins with a bigram of the template. So a licence
is found wherever it stands in a text, on one line or many. With A and B bigrams the coefficient is
2 |common| / (A + B), so it can reach t only if A is between B t / (2 - t) and B (2 - t) / t, and if at least
B t / (2 - t) bigrams are common: templates outside these bounds are not compared, a unit beyond all bounds is not even
collected whole, and windows slide only over texts with that many of a template's bigrams.

Templates are whole texts, files of `license_texts` named by their SPDX identifiers, and the notices and short forms below.

Defined results: a null text, or one without two words in a row, has no licence; of equal coefficients the
first name wins; repeated rows give repeated results; an empty table gives an empty result; other columns, clashing
names too, are ignored; every text, very long ones too, is scanned whole, by one task.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fathom.llm.common import in_batches, read, texts

LEAST = 0.8

# Licence notices and short licence texts as their authors publish them.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU Lesser General Public License for more details.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU Affero General Public License for more details.",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/",
    ),
)

#: Whole texts, by SPDX identifier.
TEMPLATES = NOTICES + tuple((f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in sorted(files("fathom.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt"))

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b == 10 else 32 for b in range(256))


def bigrams(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:]))


class Scanner:
    """Finds the best template of each text."""

    def __init__(self, templates=TEMPLATES, least: float = LEAST):
        self.least = least
        split = [(name, text.encode().translate(_TABLE).split()) for name, text in templates]
        own = [(len(b), name, b, len(words)) for name, words in split if (b := bigrams(words))]
        self.templates = sorted(own, key=lambda t: (t[0], t[1]))
        self.sizes = [t[0] for t in self.templates]
        self.any = frozenset().union(*(t[2] for t in self.templates))
        self.most = (self.sizes[-1] if self.sizes else 0) * (2 - least) / least

    def _compare(self, words: list[bytes], best: dict[str, float]) -> None:
        found: set[tuple[bytes, bytes]] = set()
        for at in range(0, len(words), 4096):
            found |= bigrams(words[at : at + 4097])
            if len(found) > self.most:
                return
        n, t = len(found), self.least
        met = found & self.any
        low, high = n * t / (2 - t), min(n * (2 - t) / t, len(met) * (2 - t) / t)  # what is common is in met
        for size, name, own, _ in self.templates[bisect_left(self.sizes, low - 1e-9) : bisect_right(self.sizes, high + 1e-9)]:
            dice = 2 * len(met & own) / (n + size)
            if dice >= t and dice > best.get(name, 0.0):
                best[name] = dice

    def _windows(self, words: list[bytes], best: dict[str, float]) -> None:
        grams = list(zip(words, words[1:]))
        met = self.any.intersection(grams)
        t, where = self.least, None
        for size, name, own, n in self.templates[: bisect_right(self.sizes, len(met) * (2 - t) / t + 1e-9)]:
            if len(met & own) * (2 - t) < size * t - 1e-9:
                continue
            if where is None:
                where = [i for i, g in enumerate(grams) if g in met]
            held: Counter[tuple[bytes, bytes]] = Counter()
            common, begin, end = 0, 0, 0  # grams[begin:end] are held
            for start in where:
                if grams[start] not in own:
                    continue
                past = min(start + n - 1, len(grams))
                if start >= end:  # nothing of the last window is in this one
                    held.clear()
                    common, begin, end = 0, start, start
                for g in grams[begin:start]:
                    held[g] -= 1
                    if not held[g]:
                        del held[g]
                        common -= g in own
                for g in grams[end:past]:
                    common += not held[g] and g in own
                    held[g] += 1
                begin, end = start, past
                dice = 2 * common / (len(held) + size)
                if dice >= t and dice > best.get(name, 0.0):
                    best[name] = dice

    def __call__(self, text: bytes) -> dict[str, float]:
        """Coefficient of every licence that some unit of the text matches."""
        clean, best = text.translate(_TABLE), {}
        lines = [line.split() for line in clean.split(b"\n")]
        whole = [w for line in lines for w in line]
        self._compare(whole, best)
        self._windows(whole, best)
        if len(lines) > 1:
            seen = set()
            for line in lines:
                if len(line) > 1 and (key := tuple(line)) not in seen:
                    seen.add(key)
                    self._compare(line, best)
            if sum(not line for line in lines):
                for part in re.split(rb"\n *\n", clean):
                    if b"\n" in part:
                        self._compare(part.split(), best)
        return best


def scan(docs: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, license, dice, licenses): the best match and all matched names, sorted, joined by commas; null without one."""

    def run(batches):
        scanner = Scanner(templates, least)
        for batch in in_batches(batches, "text"):
            found = [scanner(t) for t in texts(batch.column("text"))]
            best = [min(f.items(), key=lambda x: (-x[1], x[0])) if f else (None, None) for f in found]
            columns = [pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64()), pa.array([",".join(sorted(f)) if f else None for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "license", "dice", "licenses"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, dice double, licenses string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _values() -> str:
    quoted = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES)
    return f"(VALUES {quoted})"


def _sql_words(text: str) -> str:
    lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"list_filter(regexp_split_to_array({lower}, '[^a-z0-9]+'), lambda w: w <> '')"


def _sql_bigrams(words: str) -> str:
    return f"list_distinct(list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]))"


SQL = f"""
WITH clean AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
units AS (
    SELECT doc_id, text AS unit FROM clean
    UNION SELECT doc_id, unnest(string_split(text, chr(10))) FROM clean
    UNION SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[^A-Za-z0-9\\n]*\\n')) FROM clean
),
words AS (SELECT doc_id, {_sql_words("unit")} AS w FROM units),
grams AS (SELECT doc_id, {_sql_bigrams("w")} AS g FROM words WHERE len(w) > 1),
raw AS (SELECT row_number() OVER () AS id, col0 AS name, {_sql_words("col1")} AS w FROM {_values()}),
templates AS (SELECT id, name, len(w) AS n, {_sql_bigrams("w")} AS t FROM raw),
of_template AS (SELECT id, name, n, len(t) AS b, unnest(t) AS gram FROM templates),
grams_at AS (
    SELECT doc_id, unnest(range(1, len(w))) AS p, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram
    FROM (SELECT DISTINCT doc_id, {_sql_words("text")} AS w FROM clean)
),
hits AS (SELECT g.doc_id, g.p, t.id, t.name, t.n, t.b, g.gram FROM grams_at g JOIN of_template t ON g.gram = t.gram),
likely AS (SELECT doc_id, id FROM hits GROUP BY doc_id, id HAVING count(DISTINCT gram) * {2 - LEAST} >= any_value(b) * {LEAST} - 1e-9),
starts AS (SELECT doc_id, id, name, n, b, p FROM hits JOIN likely USING (doc_id, id)),
windows AS (
    SELECT s.doc_id, s.name, CAST(2 * count(DISTINCT t.gram) AS DOUBLE) / (count(DISTINCT g.gram) + any_value(s.b)) AS dice
    FROM starts s JOIN grams_at g ON g.doc_id = s.doc_id AND g.p >= s.p AND g.p < s.p + s.n - 1 LEFT JOIN of_template t ON t.id = s.id AND t.gram = g.gram
    GROUP BY s.doc_id, s.id, s.name, s.p
),
pairs AS (
    SELECT doc_id, name, CAST(2 * len(list_intersect(g, t)) AS DOUBLE) / (len(g) + len(t)) AS dice
    FROM grams JOIN templates ON len(g) * {LEAST} <= len(t) * {2 - LEAST} + 1e-9 AND len(t) * {LEAST} <= len(g) * {2 - LEAST} + 1e-9
),
best AS (SELECT doc_id, name, max(dice) AS dice FROM (FROM pairs UNION ALL FROM windows) WHERE dice >= {LEAST} GROUP BY doc_id, name),
of_doc AS (SELECT doc_id, first(name ORDER BY dice DESC, name) AS license, max(dice) AS dice, string_agg(name, ',' ORDER BY name) AS licenses FROM best GROUP BY doc_id)
SELECT d.doc_id, o.license, o.dice, o.licenses FROM documents d LEFT JOIN of_doc o ON o.doc_id = d.doc_id
"""
