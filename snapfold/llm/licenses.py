"""Licence scans: Dice coefficient over word bigrams against licence templates, in DataFrame operations.

A unit is a whole text, a paragraph (between blank lines) or a line, normalised to lower-case words. The Dice
coefficient 2|A n B| / (|A| + |B|) of distinct bigrams can reach t only if the sizes are within a factor of
t / (2 - t) of each other, and only if the unit holds some of a template's less common words; both prune templates
before any bigram is made.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapfold.llm import spans as S
from snapfold.llm.common import cut, spread

# Paragraphs of public licences that stand in several templates.
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."

#: Public licence notices, by SPDX identifier: what files say of their licence, its paragraphs, and the whole of short ones.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        _MIT,
        f"MIT License {_MIT} {_MIT_WARRANTY}",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        _BSD_NAMES,
        f"{_BSD} {_BSD_TWO} 3. {_BSD_NAMES} {_BSD_WARRANTY}",
    ),
    "BSD-2-Clause": (_BSD, f"{_BSD} {_BSD_TWO} {_BSD_WARRANTY}"),
    "ISC": (_ISC, f"{_ISC} {_ISC_WARRANTY}"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
THRESHOLD = 0.8


class Template(NamedTuple):
    license: str
    bigrams: tuple[str, ...]
    anchors: tuple[str, ...]


def bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def templates_of(spark: SparkSession, folder: str) -> dict[str, tuple[str, ...]]:
    """Templates from a folder of licence texts, one file each, named by its identifier. A bounded set: they go into the plan."""
    found: dict[str, tuple[str, ...]] = {}
    for path, content in spark.read.text(folder, wholetext=True).select(F.input_file_name(), "value").collect():
        name = path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".txt")
        found[name] = (*found.get(name, ()), content)
    return found


def compile_templates(templates: Mapping[str, tuple[str, ...]], threshold: float) -> list[Template]:
    """Distinct bigrams, and anchors: words one of which any unit within the threshold holds.

    Such a unit shares at least threshold / (2 - threshold) of a template's bigrams, so words that cover more than the
    rest cannot all be missing. Words that few templates have come first.
    """
    sets = [(name, bigrams(t)) for name, texts in templates.items() for t in texts]
    common: dict[str, int] = {}
    for _, pairs in sets:
        for word in {w for p in pairs for w in p.split()}:
            common[word] = common.get(word, 0) + 1
    # Short words are frequent in any text.
    cost = lambda w: (len(w) < 5, -len(w), common[w], w)
    out = []
    for name, pairs in sets:
        spare = len(pairs) - threshold / (2 - threshold) * len(pairs)
        anchors: list[str] = []
        for word in sorted({w for p in pairs for w in p.split()}, key=cost):
            if sum(any(a in p.split() for a in anchors) for p in pairs) > spare:
                break
            anchors.append(word)
        out.append(Template(name, tuple(pairs), tuple(anchors)))
    return out


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, license (of the nearest template at or above the threshold; null if none), dice, n_licenses.

    Ties go to the first identifier in order. A null or empty text has no licence; repeated rows give repeated
    results, an empty table an empty one; extra columns are ignored.
    """
    compiled = compile_templates(templates, threshold)
    low = threshold / (2 - threshold)
    t = F.coalesce(F.col(text), F.lit(""))
    anchors = sorted({a for c in compiled for a in c.anchors})
    # Any text with a licence holds an anchor: the others (most) never leave this step.
    any_anchor = t.rlike("(?i)(?<![a-z0-9])(?:" + "|".join(anchors) + ")(?![a-z0-9])")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.lit(5), t).alias("key"), t.alias("unit_text"), any_anchor.alias("open"))
    t = F.col("unit_text")
    units = F.array_distinct(F.concat(F.array(t), F.split(t, r"\n[\x20\t\r]*\n"), F.split(t, "\n")))
    each = rows.where("open").select("doc_id", "key", F.explode(F.filter(units, lambda u: u.rlike("[A-Za-z0-9]"))).alias("unit"))
    each = each.select("doc_id", "key", _words(F.col("unit")).alias("words"))
    longest = max(len(c.bigrams) for c in compiled)
    # A unit with more distinct bigrams than any template allows has more words still; words bound bigrams from above only.
    fits = [F.arrays_overlap("words", F.array(*map(F.lit, c.anchors))) & (F.size("words") - 1 >= low * len(c.bigrams)) for c in compiled]
    near = F.array_compact(F.array(*(F.when(ok, F.lit(i)) for i, ok in enumerate(fits))))
    each = each.withColumn("near", near).where(F.size("near") > 0)
    pairs = F.array_distinct(F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b)))
    each = each.where(F.size("words") > 1).withColumn("pairs", pairs).where(F.size("pairs") * low <= longest)
    dice = []
    for i, c in enumerate(compiled):
        size = F.size("pairs")
        within = F.array_contains("near", i) & (size >= low * len(c.bigrams)) & (size * low <= len(c.bigrams))
        value = 2.0 * F.size(F.array_intersect("pairs", F.array(*map(F.lit, c.bigrams)))) / (size + len(c.bigrams))
        dice.append(F.when(within, F.struct(value.alias("dice"), F.lit(c.license).alias("license"))))
    hits = each.select("doc_id", "key", F.explode(F.filter(F.array_compact(F.array(*dice)), lambda x: x["dice"] >= threshold)).alias("x"))
    best = hits.groupBy(S.row_key("doc_id", "key").alias("row_key")).agg(F.min(F.struct((-F.col("x.dice")).alias("order"), F.col("x.license").alias("license"))).alias("best"), F.count_distinct("x.license").alias("n"))
    every = cut(rows.select("doc_id", S.row_key("doc_id", "key").alias("row_key")))
    out = spread(every, "row_key")(best, "left")  # rows equal in id and text may be a great part of all
    return out.select("doc_id", F.col("best.license").alias("license"), F.round(-F.col("best.order"), 6).alias("dice"), F.coalesce("n", F.lit(0)).cast("long").alias("n_licenses"))
