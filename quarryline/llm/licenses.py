"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import math
import re
from collections import OrderedDict
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Licence identifiers and the texts that state them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Proprietary", "All rights reserved."),
)

_GPL_HEADERS = {name: text for name, text in TEMPLATES if name.startswith("GPL") and len(text) > 100}
#: Further statements, looked for as runs of words only (the SQL doesn't hold them). They keep near relatives apart.
NOTICES = (
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", _GPL_HEADERS["GPL-3.0"].replace("GNU General", "GNU Lesser General")),
    ("LGPL-2.1", _GPL_HEADERS["GPL-2.0"].replace("GNU General", "GNU Lesser General").replace("version 2", "version 2.1")),
    ("AGPL-3.0", _GPL_HEADERS["GPL-3.0"].replace("GNU General", "GNU Affero General")),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    *(
        (f"CC-{kind}-4.0", f"{start} Creative Commons Attribution{more} 4.0 International {end}")
        for kind, more in (("BY", ""), ("BY-SA", "-ShareAlike"), ("BY-NC", "-NonCommercial"), ("BY-ND", "-NoDerivatives"), ("BY-NC-SA", "-NonCommercial-ShareAlike"), ("BY-NC-ND", "-NonCommercial-NoDerivatives"))
        for start, end in (("", "Public License"), ("This work is licensed under a", "License"))
    ),
)
#: A run that shares so many bigrams with a template is a licence or its header; these outrank short statements.
LONG = 30

_OTHER = re.compile(r"[^a-z0-9]+")


def words_of(text: str) -> list[str]:
    """Runs of a-z and 0-9 in lower case (ASCII letters only are lowered)."""
    return _OTHER.sub(" ", text.translate(_LOWER)).split()


_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def bigrams(words: list[str]) -> frozenset[str]:
    return frozenset(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Numbers of bigrams that a unit can have to reach the threshold with a template of n: 2 min / (n + m) must do."""
    return math.ceil(threshold * n / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def full_texts() -> tuple[tuple[str, str], ...]:
    """Licences and their whole texts, from the files in license_texts."""
    return tuple((f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


def least_shared(n: int, threshold: float) -> int:
    """Bigrams that a unit must share with a template of n: 2 c >= threshold (n + m), and m >= c."""
    return math.ceil(threshold * n / (2 - threshold) - 1e-9)


def runs_of(grams: list[str], b: frozenset[str], threshold: float) -> list[tuple[int, float, int, int]]:
    """(shared bigrams, Dice, first word, word after) of the best runs of a document's words against one template, none overlapping.

    A best run ends where a stretch of the template's bigrams ends, as one more of them never lowers Dice. At each such
    end, the distinct bigrams are gone through from the last seen backwards: these are the runs that end there.
    """
    n, (_, high), need = len(b), size_bounds(len(b), threshold), least_shared(len(b), threshold)
    seen: OrderedDict[str, int] = OrderedDict()  # the last distinct bigrams, at most high, by their last places
    inside = 0
    found: list[tuple[int, float, int, int]] = []
    for at, g in enumerate(grams):
        of_b = g in b
        if g in seen:
            seen.move_to_end(g)
        else:
            inside += of_b
        seen[g] = at
        if len(seen) > high:
            inside -= seen.popitem(last=False)[0] in b
        if of_b and inside >= need and (at + 1 == len(grams) or grams[at + 1] not in b):
            shared, best = 0, (0, 0.0, 0, 0)
            for size, (x, start) in enumerate(reversed(seen.items()), 1):
                if x in b:
                    shared += 1
                    dice = 2 * shared / (n + size)
                    if dice > best[1]:
                        best = (shared, dice, start, at + 2)
            if best[1] >= threshold:
                if not found or best[2] >= found[-1][3]:
                    found.append(best)
                elif best[1] > found[-1][1]:
                    found[-1] = best
    return found


def _scan(threshold: float, templates: tuple, further: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(name, bigrams(words_of(text))) for name, text in templates]
        bounds = [(*size_bounds(len(b), threshold), name, b) for name, b in known]
        low, high = min(b[0] for b in bounds), max(b[1] for b in bounds)
        of_any = frozenset().union(*(b for _, b in known))
        searched = list(dict.fromkeys([*known, *((name, bigrams(words_of(text))) for name, text in further)]))
        # a run shares at least `least` of a template's bigrams, and so one of any n - least + 1: the longest, which are rare
        least = [least_shared(len(b), threshold) for _, b in searched]
        by_anchor: dict[str, list[int]] = {}
        for i, (_, b) in enumerate(searched):
            for g in sorted(b, key=lambda g: (-len(g), g))[: len(b) - least[i] + 1]:
                by_anchor.setdefault(g, []).append(i)
        anchors = frozenset(by_anchor)
        for batch in batches:
            names, best, found = [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                lines = text.split("\n")
                words_by_line = [words_of(line) for line in lines]
                words = [w for ws in words_by_line for w in ws]
                all_grams = bigrams(words)
                units = dict(zip(lines, words_by_line, strict=True))
                hits: dict[str, float] = {}
                long: dict[str, float] = {}
                good: set[str] = set()
                for unit in {*units, text}:
                    if len(unit) <= 2 * low:
                        continue
                    grams = all_grams if unit == text else bigrams(units[unit])
                    if not low <= len(grams) <= high or of_any.isdisjoint(grams):
                        continue
                    for lo, hi, name, b in bounds:
                        if lo <= len(grams) <= hi:
                            shared = len(grams & b)
                            dice = 2 * shared / (len(grams) + len(b))
                            if dice >= threshold:
                                hits[name] = max(hits.get(name, 0.0), dice)
                                good.add(unit)
                                if shared >= LONG:
                                    long[name] = max(long.get(name, 0.0), dice)
                n_units, any_long = len(good), False
                near = {i for g in all_grams & anchors for i in by_anchor[g]} if text not in good else ()
                near = [i for i in near if len(all_grams & searched[i][1]) >= least[i]]
                if near:
                    grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
                    runs = sorted((-shared, -dice, searched[i][0], start, end) for i in near for shared, dice, start, end in runs_of(grams, searched[i][1], threshold))
                    taken: list[tuple[int, int]] = []
                    at = 0
                    spans = []  # words of the lines that match
                    for line, ws in zip(lines, words_by_line, strict=True):
                        if line in good:
                            spans.append((at, at + len(ws)))
                        at += len(ws)
                    extra = set()
                    for shared, dice, name, start, end in runs:
                        if any(start < y and x < end for x, y in taken):
                            continue
                        taken.append((start, end))
                        if any(x <= start and end <= y for x, y in spans):  # its line is a unit already; the run may tell its licence better
                            if name not in hits:
                                hits[name] = -dice
                            continue
                        extra.add(" ".join(words[start:end]))
                        hits[name] = max(hits.get(name, 0.0), -dice)
                        if -shared >= LONG:
                            any_long = True
                            long[name] = max(long.get(name, 0.0), -dice)
                    n_units += len(extra)
                top = min(((-v, k) for k, v in (long if any_long else hits).items()), default=None)
                names.append(top and top[1]), best.append(-top[0] if top else 0.0), found.append(n_units)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(best, pa.float64()), pa.array(found, pa.int64())], ["doc_id", "license", "dice", "n_units"])

    return run


def scan_licenses(docs: DataFrame, *, threshold: float = 0.8, templates: tuple = TEMPLATES, further: tuple | None = None) -> DataFrame:
    """Per row of docs: doc_id, license (of the best template, null if none), dice, n_units (texts, lines or runs of words that match).

    The units of a document are its whole text and its distinct lines. A unit is compared by Dice over sets of word
    bigrams with those templates whose size allows the threshold: Dice can't exceed 2 min(m, n) / (m + n). Where the
    whole text doesn't match, the best runs of words across lines are looked for too, of the templates and of `further`
    (NOTICES and full_texts() unless given); of runs that overlap, the one that shares most with its template is
    taken, and one within a matching line isn't a unit of its own. Best is the highest coefficient, ties to the smaller
    name; where runs of LONG shared bigrams or more are found, of such matches only. A null text counts as empty and
    matches nothing; null and repeated doc_ids keep their rows; an empty table gives an empty result; other columns are
    ignored. No shuffle.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    more = (*NOTICES, *full_texts()) if further is None else further
    return texts.mapInArrow(_scan(threshold, templates, more), "doc_id long, license string, dice double, n_units long")


def oracle_sql(threshold: float = 0.8, templates: tuple = TEMPLATES) -> str:
    """The result over whole texts and lines of up to 1,000 words in DuckDB's SQL, without runs of words."""
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in templates)
    norm = "list_filter(string_split(trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH templates AS (SELECT name, {grams} AS b FROM (SELECT name, {norm.format('body')} AS w FROM (VALUES {rows}) AS v(name, body))),
units AS (
  SELECT DISTINCT doc_id, unit FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS unit FROM documents
    UNION ALL SELECT doc_id, coalesce(text, '') FROM documents)
  WHERE length(unit) > 0
),
sized AS (SELECT doc_id, unit, {grams} AS g FROM (SELECT doc_id, unit, {norm.format('unit')} AS w FROM units) WHERE len(w) BETWEEN 2 AND 1000),
scored AS (
  SELECT doc_id, unit, name, 2 * len(list_intersect(g, b))::DOUBLE / (len(g) + len(b)) AS dice FROM sized, templates
  WHERE len(g) > 0 AND 2 * least(len(g), len(b)) >= {threshold} * (len(g) + len(b))
),
good AS (SELECT * FROM scored WHERE dice >= {threshold}),
best AS (SELECT doc_id, arg_min(name, (-d, name)) AS license, max(d) AS dice FROM (SELECT doc_id, name, max(dice) AS d FROM good GROUP BY ALL) GROUP BY doc_id),
counted AS (SELECT doc_id, count(DISTINCT unit) AS n FROM good GROUP BY doc_id)
SELECT d.doc_id, license, coalesce(dice, 0)::DOUBLE AS dice, coalesce(n, 0)::BIGINT AS n_units
FROM documents d LEFT JOIN best USING (doc_id) LEFT JOIN counted USING (doc_id)
"""
