"""Licence scans: passages compared with licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import read

# Wordings of public licences and of the notices that name them.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the terms of the Apache License 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU GPL v3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "Licensed under the zlib License."),
]

_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    """Normalised text: lower-case runs of letters, digits and underscores."""
    return _WORD.findall(text.lower())


def bigrams(own: list[str]) -> set[tuple[str, str]]:
    return set(zip(own, own[1:]))


def full_texts() -> list[tuple[str, str]]:
    """Whole texts of common licences, from the files beside this module, named by their identifiers."""
    folder = Path(__file__).with_name("licence_texts")
    return [(f.stem, f.read_text(encoding="utf-8")) for f in sorted(folder.glob("*.txt"))]


class Scanner:
    """Finds the passages (runs of words) of a text that are nearest to a template.

    A passage starts and ends with a bigram of the template, as any other one at an end only lowers the coefficient. With
    ``least`` d it shares at least d / (2 - d) of the template's bigrams and has at most (2 - d) / d times as many itself: these
    size bounds rule out most templates and starts.
    """

    def __init__(self, templates: list[tuple[str, str]], least: float):
        self.least = least
        # the largest first, so that of equal coefficients the longest passage stays
        self.templates = sorted([(name, len(g), g) for name, text in templates if (g := bigrams(words(text)))], key=lambda t: -t[1])
        ratio = least / (2 - least)
        self.need = [math.ceil(m * ratio - 1e-9) for _, m, _ in self.templates]
        self.most = [math.floor(m / ratio + 1e-9) for _, m, _ in self.templates]
        self.known: dict[tuple[str, str], list[int]] = {}
        for k, (_, _, g) in enumerate(self.templates):
            for x in g:
                self.known.setdefault(x, []).append(k)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """Best match of every licence found: name, coefficient, first and last word."""
        if not text:
            return []
        own = words(text)
        pairs = list(zip(own, own[1:]))
        hits: dict[int, list[int]] = {}
        known = self.known
        for i, x in enumerate(pairs):
            if x in known:
                for k in known[x]:
                    hits.setdefault(k, []).append(i)
        best: dict[str, tuple[str, float, int, int]] = {}
        for k, at in sorted(hits.items()):
            if len(at) >= self.need[k]:
                name, m, _ = self.templates[k]
                floor = best[name][1] if name in best else 0.0
                got = self.passage(k, at, pairs, floor)
                if got:
                    best[name] = (name, *got)
        return sorted(best.values(), key=lambda x: (-x[1], x[0]))

    def passage(self, k: int, at: list[int], pairs: list[tuple[str, str]], floor: float) -> tuple[float, int, int] | None:
        """The best run between two hits of a template that is above ``floor``."""
        (_, m, _), need, most, found = self.templates[k], self.need[k], self.most[k], None
        spare, skip = m // 8, 0
        end, where = 0, {}  # the latest place of each bigram of the run, to know its distinct ones
        for s, start in enumerate(at):
            # no run has more than ``most`` distinct bigrams: how far that (and some spare) reaches, moving on from the last start
            if s:
                for i in range(at[s - 1], start):
                    if where.get(pairs[i]) == i:
                        del where[pairs[i]]
            end = max(end, start)
            while end < len(pairs) and (pairs[end] in where or len(where) < most + spare):
                where[pairs[end]] = end
                end += 1
            n = bisect_left(at, end) - s
            top = 2 * min(n, m) / (min(n, m) + m)
            if n < need or top < self.least - 1e-12 or top <= floor or start < skip:
                continue
            run, shared, last, near = set(), set(), start, 0.0
            for j in at[s : s + n]:
                run.update(pairs[last : j + 1])
                last = j + 1
                shared.add(pairs[j])
                dice = 2 * len(shared) / (len(run) + m)
                near = max(near, dice)
                if dice >= self.least - 1e-12 and dice > floor:
                    floor, found = dice, (dice, start, j + 1)
            # a run that starts d words later shares no more and has at most d bigrams fewer, so it needs some d to do better
            skip = start + min(spare, int((m + need) * (1 - near / max(floor, self.least - 1e-12))))
        return found


def scan(docs: DataFrame, *, templates: list[tuple[str, str]] | None = None, least: float = 0.8, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Licences that whole texts state anywhere, also inside a line; one row per row, without a shuffle.

    Returns doc_id, license (the best match by coefficient, then name; null if none), dice (null if none), n_licenses and
    matches (name, dice, first_word, last_word of each licence's best passage, of equal ones that of the
    largest template and then the earliest; words count from 0).
    Null, empty and wordless texts match nothing; long texts are scanned whole; repeated rows and null ids stay; an empty table
    gives no rows; other columns are not read.
    """
    own = TEMPLATES + full_texts() if templates is None else templates

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(own, least)
        for b in batches:
            got = [scanner.scan(None if pd.isna(t) else t) for t in b["text"]]
            names = ("name", "dice", "first_word", "last_word")
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64"), "license": [g[0][0] if g else None for g in got],
                "dice": [g[0][1] if g else None for g in got], "n_licenses": [len(g) for g in got],
                "matches": [[dict(zip(names, m, strict=True)) for m in g] for g in got],
            })

    schema = (
        "doc_id long, license string, dice double, n_licenses long, "
        "matches array<struct<name: string, dice: double, first_word: int, last_word: int>>"
    )
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences stated in all ``documents``."""
    names = F.array_sort(F.transform("matches", lambda m: m["name"]))
    return scan(read(spark, sf_dir, "documents")).select(
        "doc_id", "license", "dice", "n_licenses", F.array_join(names, ",").alias("licenses")
    )
