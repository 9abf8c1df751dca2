"""Licence notices: lines compared with licence templates by Dice coefficient. DataFrame operations only.

A line is lower-cased, everything but letters and digits becomes a blank, and its distinct word bigrams are compared
with each template's: twice the number in common over the sum of both numbers. A line of a bigrams can only reach t
with a template of b bigrams if b t / (2 - t) <= a <= b (2 - t) / t, so other templates are not compared at all.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Notices by which works name their licence, several for some licences.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.", "SPDX-License-Identifier: MIT"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
_GNU = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} General Public License as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version."
#: Longer texts, looked for in passages only: usual headers and a clause that tells a licence.
HEADERS: dict[str, tuple[str, ...]] = {
    "GPL-3.0": (_GNU.format(":", "", ",", 3),),
    "GPL-2.0": (_GNU.format(";", "", ";", 2),),
    "LGPL-3.0": (_GNU.format(":", "Lesser", ",", 3),),
    "AGPL-3.0": (_GNU.format(":", "Affero", ",", 3),),
    "BSD-3-Clause": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
}
_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Whole licence texts, as published (fixed values), without the copyright line.
TEXTS: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": f"{_CONDITIONS} {_DISCLAIMER}",
    "BSD-3-Clause": f"{_CONDITIONS} 3. {HEADERS['BSD-3-Clause'][0]} {_DISCLAIMER}",
    "GPL-3.0": f"{HEADERS['GPL-3.0'][0]} This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
#: Rare bigrams by which a whole text's place is found, and shifts and lengths of the windows tried around it.
PLACES = 6
SHIFTS = (-12, -6, -3, 0, 3, 6, 12)
LENGTHS = (0.85, 1.0, 1.15)
#: Frequent words, tried last where lines are told apart by single words.
COMMON = ("a", "and", "by", "for", "in", "is", "of", "on", "or", "the", "this", "to", "under", "with")


def words_of(text: str) -> list[str]:
    """A template's words, as a line's are taken in SQL."""
    return [w for w in re.sub(r"[^\w]|_", " ", text.lower()).split() if w]


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Least and greatest number of bigrams that can reach ``threshold`` with n bigrams."""
    low = next(a for a in range(n + 1) if 2 * min(a, n) >= threshold * (a + n))
    high = n
    while 2 * n >= threshold * (high + 1 + n):
        high += 1
    return low, high


def anchors(templates: Mapping[str, tuple[str, ...]], threshold: float) -> list[str]:
    """Words of which a line has to contain one, be it inside a word, to reach ``threshold`` with any template.

    A line in reach may lack only so many of a template's bigrams; words that are in more of them than that, the
    longest first, can't all be absent.
    """
    out: set[str] = set()
    for t in (t for ts in templates.values() for t in ts):
        own = bigrams_of(t)
        if not own:
            continue
        low, _ = size_bounds(len(own), threshold)
        lacks = len(own) - next(c for c in range(len(own) + 1) if 2 * c >= threshold * (low + len(own)))
        chosen: set[str] = set()
        for w in sorted(set(words_of(t)), key=lambda w: (w in COMMON, -len(w), w)):
            if sum(bool(chosen & set(b.split())) for b in own) > lacks:
                break
            chosen.add(w)
        out |= chosen
    return sorted(w for w in out if not any(v in w for v in out if v != w))


def _dice(bigrams: Column, size: Column, templates: Mapping[str, tuple[str, ...]], threshold: float) -> Column:
    """(dice, negated rank, licence) of the best template, null below the threshold. Sizes decide first."""
    scored, rank = [], 0
    for name in sorted(templates):
        for t in templates[name]:
            own = bigrams_of(t)
            if not own:
                continue
            low, high = size_bounds(len(own), threshold)
            common = F.size(F.array_intersect(bigrams, F.array(*map(F.lit, own))))
            dice = 2.0 * common / (size + len(own))
            found = F.when(size.between(low, high) & (2 * common >= threshold * (size + len(own))), F.struct(dice.alias("dice"), F.lit(-rank).alias("rank"), F.lit(name).alias("license")))
            scored.append(found)
            rank += 1
    return F.greatest(*scored) if len(scored) > 1 else scored[0]


def license_lines(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The ``keep`` columns with line (from 0), license and dice of each line that reaches ``threshold`` with a
    template; the best template, ties to the licence first in order. Null and empty texts have no lines. Rows stay
    where they are: nothing is shuffled. ``threshold`` lies above 0 and at most at 1.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and at most at 1")
    bounds = [size_bounds(len(b), threshold) for ts in templates.values() for t in ts if (b := bigrams_of(t))]
    if not bounds:
        raise ValueError("no template has two words")
    low, high = min(b[0] for b in bounds), max(b[1] for b in bounds)
    words = anchors(templates, threshold)

    def near(line: Column) -> Column:
        return reduce(Column.__or__, [F.contains(line["x"], F.lit(w)) for w in words], F.lit(False))

    # lines without any of the words go before they are rows: a test below might be evaluated ahead of this one
    numbered = F.transform(F.split(F.lower(text), "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("x")))
    lines = docs.select(*keep, F.explode(F.filter(numbered, near)).alias("__l")).select(*keep, F.col("__l.line").alias("line"), F.col("__l.x").alias("__x"))
    normal = F.btrim(F.regexp_replace("__x", r"[^\p{L}\p{M}\p{N}]+", " "))
    lines = lines.select(*keep, "line", F.split(normal, " ").alias("__w"))
    # distinct bigrams may be far fewer than words, so only the lower bound can be put on words
    lines = lines.where(F.size("__w") > low)
    pair = F.zip_with(F.slice("__w", 1, F.size("__w") - 1), F.slice("__w", 2, F.size("__w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    lines = lines.select(*keep, "line", F.array_distinct(pair).alias("__b")).withColumn("__n", F.size("__b")).where(F.col("__n").between(low, high))
    best = lines.select(*keep, "line", _dice(F.col("__b"), F.col("__n"), templates, threshold).alias("__best")).where("__best IS NOT NULL")
    return best.select(*keep, "line", F.col("__best.license").alias("license"), F.col("__best.dice").alias("dice"))


def license_passages(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", templates: Mapping[str, tuple[str, ...]] = TEMPLATES, headers: Mapping[str, tuple[str, ...]] = HEADERS, threshold: float = THRESHOLD) -> DataFrame:
    """The ``keep`` columns with row (a hash of the text), line, license and dice of notices wrapped over lines or
    within longer ones: around each anchor word the best run of words, which begins and ends with a bigram of the
    template and is no longer than the size bounds let it be. Lines that reach the threshold as a whole are left to
    ``license_lines``. A notice is found from each of its anchor words, so rows repeat.
    """
    both = {n: (*templates.get(n, ()), *headers.get(n, ())) for n in {*templates, *headers}}
    words = anchors(both, threshold)
    kept = [(n, t, b) for n in sorted(both) for t in both[n] if (b := bigrams_of(t))]
    # bigrams in a row: a text's own repetitions come on top of the distinct ones
    longest = [size_bounds(len(b), threshold)[1] + len(words_of(t)) - 1 - len(b) for _, t, b in kept]
    reach = max(longest) + 1

    def near(x: Column) -> Column:
        return reduce(Column.__or__, [F.contains(x, F.lit(w)) for w in words])

    def split(x: Column) -> Column:
        return F.split(F.btrim(F.regexp_replace(x, r"[^\p{L}\p{M}\p{N}]+", " ")), " ")

    def pairs(w: Column) -> Column:
        return F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))

    def whole(x: Column) -> Column:
        # bound once, since a lambda's expressions are evaluated wherever they stand
        return F.element_at(F.transform(F.array(F.array_distinct(pairs(split(x)))), lambda b: _dice(b, F.size(b), templates, threshold).isNotNull()), 1)

    rows = docs.where(near(F.lower(text))).select(*keep, F.xxhash64(text).alias("row"), F.split(F.lower(text), "\n").alias("__ls"))
    # a line found as a whole becomes one word that no template has
    left = F.transform("__ls", lambda x: F.when(near(x) & whole(x), F.lit("|")).otherwise(x))
    rows = rows.select(*keep, "row", left.alias("__ls")).where(F.exists("__ls", near))
    said = F.flatten(F.transform("__ls", lambda x, i: F.transform(F.when(x == "|", F.array(F.lit("|"))).otherwise(F.filter(split(x), lambda w: w != "")), lambda w: F.struct(w.alias("w"), i.alias("line")))))
    rows = rows.select(*keep, "row", said.alias("__w"))
    found = F.filter(F.transform("__w", lambda x, i: F.when(near(x["w"]), i)), lambda i: i.isNotNull())
    # what lies in reach of an anchor is cut out before it becomes a row, so that no row holds the whole text
    around = F.transform(found, lambda i: F.slice("__w", F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + reach + 1))
    rows = rows.select(*keep, "row", F.explode(around).alias("__w"))
    rows = rows.select(*keep, "row", F.col("__w.line").alias("__at"), pairs(F.col("__w.w")).alias("__b"))

    def run(rank: int, name: str, own: list[str], most: int) -> Column:
        low, high = size_bounds(len(own), threshold)
        need = next(c for c in range(len(own) + 1) if 2 * c >= threshold * (low + len(own)))
        mine = F.array(*map(F.lit, own))

        def score(d: Column, i: Column) -> Column:
            n = F.size(F.array_intersect(d, mine))
            ok = F.size(d).between(low, high) & (2 * n >= threshold * (F.size(d) + len(own)))
            return F.when(ok, F.struct((2.0 * n / (F.size(d) + len(own))).alias("dice"), F.lit(-rank).alias("rank"), (-i).alias("start"), F.lit(name).alias("license")))

        def windows(hits: Column) -> Column:
            def ends(i: Column) -> Column:
                within = F.filter(hits, lambda j: (j - i + 1).between(low, most))
                return F.array_max(F.transform(F.transform(within, lambda j: F.array_distinct(F.slice("__b", i + 1, j - i + 1))), lambda d: score(d, i)))

            return F.when(F.size(hits) >= need, F.array_max(F.transform(hits, ends)))

        hits = F.filter(F.transform("__b", lambda b, i: F.when(F.array_contains(mine, b), i)), lambda i: i.isNotNull())
        return F.element_at(F.transform(F.array(hits), windows), 1)

    best = [run(rank, name, own, most) for rank, ((name, _, own), most) in enumerate(zip(kept, longest))]
    best = best if len(best) > 1 else best * 2
    rows = rows.select(*keep, "row", "__at", F.greatest(*best).alias("__best")).where("__best IS NOT NULL")
    return rows.select(*keep, "row", F.element_at("__at", 1 - F.col("__best.start")).alias("line"), F.col("__best.license").alias("license"), F.col("__best.dice").alias("dice"))


def places(text: str, n: int = PLACES) -> list[tuple[str, int]]:
    """The ``n`` bigrams of a text, one from each stretch of it, that are least likely elsewhere - the longest that occur
    once - with their places."""
    w = words_of(text)
    pairs = [f"{a} {b}" for a, b in zip(w, w[1:])]
    cut = -(-len(pairs) // n)
    out = []
    for at in range(0, len(pairs), cut):
        once = [(-min(map(len, p.split())), -len(p), i, p) for i, p in enumerate(pairs[at : at + cut], at) if pairs.count(p) == 1]
        out += [(p, i) for *_, i, p in sorted(once)[:1]]
    return out


def license_texts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", texts: Mapping[str, str] = TEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """The ``keep`` columns with row (a hash of the text), line, license and dice of whole licence texts, however they are
    wrapped. A text is looked for where one of its ``places`` stands: windows of about its length, begun about where
    it would begin, are compared with it, so edits may move it by some words. The best of a place is given; ties go
    to the licence first in order."""
    known = [(name, sorted({*bigrams_of(t)}), places(t), len(words_of(t)) - 1) for name, t in sorted(texts.items())]
    # every place is a bigram, whose longer word has to be somewhere
    words = sorted({max(p.split(), key=len) for _, _, at, _ in known for p, _ in at})
    words = [w for w in words if not any(v in w for v in words if v != w)]
    spots = sorted((p, k, i) for k, (_, _, at, _) in enumerate(known) for p, i in at)
    rows = docs.where(reduce(Column.__or__, [F.contains(F.lower(text), F.lit(w)) for w in words]))
    line = lambda x, i: F.transform(F.filter(F.split(F.btrim(F.regexp_replace(x, r"[^\p{L}\p{M}\p{N}]+", " ")), " "), lambda w: w != ""), lambda w: F.struct(w.alias("w"), i.alias("line")))
    rows = rows.select(*keep, F.xxhash64(text).alias("row"), F.flatten(F.transform(F.split(F.lower(text), "\n"), line)).alias("__w"))
    rows = rows.where(F.size("__w") > 1).select(*keep, "row", "__w", F.transform("__w", lambda x: x["w"]).alias("__v"))
    pair = F.zip_with(F.expr("slice(__v, 1, size(__v) - 1)"), F.expr("slice(__v, 2, size(__v) - 1)"), lambda a, b: F.concat(a, F.lit(" "), b))
    rows = rows.select(*keep, "row", F.transform("__w", lambda x: x["line"]).alias("__at"), pair.alias("__b"))
    here = F.filter(F.transform("__b", lambda b, i: F.when(b.isin(sorted({p for p, _, _ in spots})), F.struct(b.alias("b"), i.alias("i")))), lambda x: x.isNotNull())
    known_spots = F.array(*[F.struct(F.lit(p).alias("b"), F.lit(k).alias("k"), F.lit(i).alias("o")) for p, k, i in spots])
    begins = lambda x: F.transform(F.filter(known_spots, lambda p: p["b"] == x["b"]), lambda p: F.struct(p["k"].alias("k"), (x["i"] - p["o"]).alias("start")))
    # the same beginning from several places is looked at once; what any window there can hold is cut out first
    lengths = F.array(*[F.lit(n) for *_, n in known])

    def cut(f: Column) -> Column:
        base = F.greatest(f["start"] + min(SHIFTS), F.lit(0))
        size = F.ceil(F.get(lengths, f["k"]) * max(LENGTHS)).cast("int") + (max(SHIFTS) - min(SHIFTS) + 2)
        return F.struct(f["k"].alias("k"), f["start"].alias("start"), base.alias("base"), F.slice("__b", base + 1, size).alias("b"), F.slice("__at", base + 1, size).alias("at"))

    starts = F.array_distinct(F.flatten(F.transform(here, begins)))
    rows = rows.select(*keep, "row", F.explode(F.transform(starts, cut)).alias("__f"))
    rows = rows.select(*keep, "row", "__f", F.col("__f.b").alias("__b"), F.col("__f.at").alias("__at"))
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("__f.k"))
    own = F.get(F.array(*[F.array(*map(F.lit, b)) for _, b, _, _ in known]), F.col("__f.k"))
    rows = rows.select(*keep, "row", "__at", "__b", "__f", own.alias("__own"), of([n for n, *_ in known]).alias("__name"), of([n for *_, n in known]).alias("__length"))

    def window(shift: Column, part: Column) -> Column:
        lo = F.greatest(F.col("__f.start") + shift, F.lit(0))
        size = F.greatest(F.round(F.col("__length") * part).cast("int") + F.least(F.col("__f.start") + shift, F.lit(0)), F.lit(0))
        # bound once, since a lambda's expressions are evaluated wherever they stand
        common = F.transform(F.array(F.array_distinct(F.slice("__b", lo - F.col("__f.base") + 1, size))), lambda d: F.struct(F.size(F.array_intersect(d, F.col("__own"))).alias("c"), (F.size(d) + F.size("__own")).alias("n")))
        return F.get(F.transform(common, lambda x: F.when(2 * x["c"] >= threshold * x["n"], F.struct((2.0 * x["c"] / x["n"]).alias("dice"), (-F.col("__f.k")).alias("rank"), lo.alias("start")))), F.lit(0))

    tried = F.flatten(F.transform(F.array(*map(F.lit, SHIFTS)), lambda s: F.transform(F.array(*map(F.lit, LENGTHS)), lambda part: window(s, part))))
    scored = F.array_max(tried)
    rows = rows.select(*keep, "row", "__at", "__f", "__name", scored.alias("__best")).where("__best IS NOT NULL")
    return rows.select(*keep, "row", F.get("__at", F.col("__best.start") - F.col("__f.base")).alias("line"), F.col("__name").alias("license"), F.col("__best.dice").alias("dice"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each id with a licence notice or text: its licences in order, number of lines that are a notice or
    in which one begins, the greatest Dice coefficient and the first such line. Rows that share an id are taken
    together; a null id is an id."""
    hashed = docs.select(doc_id, text, F.xxhash64(text).alias("row"))
    found = license_lines(hashed, (doc_id, "row"), text, templates, threshold).select(doc_id, "row", "line", "license", "dice")
    for more in (license_passages(docs, (doc_id,), text, templates, HEADERS, threshold), license_texts(docs, (doc_id,), text, TEXTS, threshold)):
        found = found.unionByName(more)
    # a line that is a notice and in which a text begins counts once
    n_lines = F.size(F.collect_set(F.struct("row", "line"))).cast("long")
    return found.groupBy(doc_id).agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"), n_lines.alias("n_lines"), F.max("dice").alias("dice"), F.min("line").cast("long").alias("first_line"))
