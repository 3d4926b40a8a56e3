"""Licence scan (DataFrame functions only): normalised text against licence templates by the Dice coefficient over word
bigrams; size bounds prune the templates that a text can't reach.

Units are the whole text, every line, every block of lines between blank lines, and every run of lines up to the size of
a template, so that a notice inside a document is compared by itself, of several paragraphs too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Licence notices and short licence texts, by SPDX-like name.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
    ),
}


# Whole texts and notices of which TEMPLATES has a part, and more licences. The full texts of Apache-2.0 and the
# GNU licences end in the notice to be used with them, which is found inside them.
FULL_TEMPLATES = {
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>.",
    ),
}
ALL_TEMPLATES = {name: TEMPLATES.get(name, ()) + FULL_TEMPLATES.get(name, ()) for name in sorted({*TEMPLATES, *FULL_TEMPLATES})}


def bigrams_of(text: str) -> list[str]:
    """Sorted distinct word bigrams of one template, normalised as normalised() does."""
    import re

    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def longest_run(templates: dict[str, tuple[str, ...]] = ALL_TEMPLATES, threshold: float = THRESHOLD) -> int:
    """Words of the longest run of lines that is a unit."""
    return int(max(len(t.split()) for ts in templates.values() for t in ts) * (2 - threshold) / threshold)


def normalised(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates: dict[str, tuple[str, ...]] = ALL_TEMPLATES) -> DataFrame:
    """One row per row of docs: doc_id, license (best match or null), score (Dice, 0 if none), licenses (all, sorted).

    The score is the best Dice coefficient of any unit with any template; ties take the first name in order. Null and empty
    texts have no licence; texts are whole however long; repeated rows give repeated results; other columns of docs are
    ignored; an empty table gives no rows.
    """
    entries = [(name, grams) for name, texts in sorted(templates.items()) for grams in map(bigrams_of, texts) if grams]
    # Dice >= t needs t/(2-t)*|T| <= |A| <= (2-t)/t*|T|.
    lo = [-(-len(g) * threshold // (2 - threshold)) for _, g in entries]
    hi = [len(g) * (2 - threshold) // threshold for _, g in entries]
    spans: list[list[int]] = []
    for a, b in sorted(zip(map(int, lo), map(int, hi), strict=True)):
        if spans and a <= spans[-1][1] + 1:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    # A unit of n distinct bigrams has n+1 words or more, and at least 2n+1 characters: short units go at once.
    least = 2 * min(a for a, _ in spans) + 1
    lines, blocks = F.split(text, "\n", -1), F.split(text, "\n[\\x20\\t\\r]*\n", -1)
    near, runs = _runs([g for _, g in entries], [-(-len(g) * threshold // (2 - threshold)) for _, g in entries], longest_run(templates, threshold))
    # A text that has none of a few words has no unit that matches: nothing of it is cut or compared.
    base = base.withColumn("low", F.lower("text")).withColumn("near", near(F.col("low")))
    base = base.select("doc_id", F.when(F.col("near"), text).alias("text"), F.when(F.col("near"), F.regexp_extract_all("low", F.lit(r"[a-z0-9]+|\n[^a-z0-9]*"), F.lit(0))).alias("tokens"))
    every = F.coalesce(F.array_union(F.array_union(F.array(text), lines), blocks), F.array().cast("array<string>"))
    units = base.select("doc_id", "tokens", F.filter(every, lambda u: F.length(u) >= least).alias("u"))
    words = units.select("doc_id", "tokens", F.transform("u", normalised).alias("u"))
    # Distinct bigrams can't exceed words - 1; far longer units that repeat little are cut by the count of distinct words,
    # as n distinct words have at least n - 1 distinct bigrams.
    top = max(b for _, b in spans)
    words = words.select("doc_id", "tokens", F.filter("u", lambda w: (F.size(w) > spans[0][0]) & (F.size(F.array_distinct(w)) - 1 <= top)).alias("u"))
    grams = runs(words.select("doc_id", "tokens", F.transform("u", _pairs).alias("u")))
    inside = lambda g: _any([F.size(g).between(a, b) for a, b in spans])
    grams = grams.select("doc_id", F.filter("u", inside).alias("u"))

    def score(g: Column, k: int) -> Column:
        own = entries[k][1]
        dice = 2.0 * F.size(F.array_intersect(g, F.array(*[F.lit(x) for x in own]))) / (F.size(g) + len(own))
        return F.when(F.size(g).between(int(lo[k]), int(hi[k])), dice).otherwise(0.0)

    names = sorted({name for name, _ in entries})

    def best(name: str):
        own = [k for k in range(len(entries)) if entries[k][0] == name]
        return lambda g: _greatest([score(g, k) for k in own])

    scores = [F.coalesce(F.array_max(F.transform("u", best(name))), F.lit(0.0)) for name in names]
    # Most documents have no unit of a fitting size; only the others are compared.
    scored = grams.select("doc_id", *[F.when(F.size("u") == 0, F.lit(0.0)).otherwise(s).alias(f"s{i}") for i, s in enumerate(scores)])
    top_score = _greatest([F.col(f"s{i}") for i in range(len(names))])
    found = scored.withColumn("score", F.when(top_score >= threshold, top_score).otherwise(0.0))
    first = F.lit(None).cast("string")
    for i, name in reversed(list(enumerate(names))):
        first = F.when((F.col("score") > 0) & (F.col(f"s{i}") == F.col("score")), F.lit(name)).otherwise(first)
    every = [F.when(F.col(f"s{i}") >= threshold, F.lit(name)) for i, name in enumerate(names)]
    return found.select("doc_id", first.alias("license"), "score", F.concat_ws(",", *every).alias("licenses"))


def _pairs(w: Column) -> Column:
    """Distinct bigrams of an array of words."""
    return F.array_distinct(F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1))))


def _runs(templates: list[list[str]], least: list[float], most: int):
    """(test of lower-case texts, step that adds to u the bigrams of runs of whole lines of at most `most` words).

    A unit that matches a template has `least` of its bigrams. So a text without any of a few words that touch all but less
    of them has no match; nor has a run whose start is not followed, within `most` words, by that many.
    """
    touched = [set() for _ in templates]
    of: dict[str, list[tuple[int, str]]] = {}
    for k, g in enumerate(templates):
        for x in g:
            for w in set(x.split()):
                of.setdefault(w, []).append((k, x))
    short = lambda k: len(templates[k]) - len(touched[k]) >= least[k]
    chosen: list[str] = []
    while any(map(short, range(len(templates)))):
        gain = {w: sum(1 / len(templates[k]) for k, x in xs if short(k) and x not in touched[k]) for w, xs in of.items()}
        w = max(gain, key=lambda w: (len(w) > 4 and gain[w] > 0, gain[w], w))  # short words and numbers are in most texts
        chosen.append(w)
        for k, x in of.pop(w):
            touched[k].add(x)

    def near(text: Column) -> Column:
        return _any([F.contains(text, F.lit(w)) for w in chosen])

    mark = lambda x: F.startswith(x, F.lit("\n"))
    words = lambda a: F.filter(a, lambda x: ~mark(x))
    # Bigrams of any template are picked out first: few are left to be compared with every template.
    every = F.array(*map(F.lit, sorted({x for t in templates for x in t})))
    few = lambda g: F.size(g) >= int(min(least))
    enough = lambda g: few(g) & _any([F.size(F.array_intersect(g, F.array(*map(F.lit, t)))) >= int(n) for t, n in zip(templates, least, strict=True)])
    # Words are bound by a lambda of their own: inside another one they would be picked out anew for every pair.
    held = lambda a, f: F.size(F.filter(F.transform(F.transform(F.array(a), words), lambda w: F.array_intersect(_pairs(w), every)), f)) > 0

    def step(rows: DataFrame) -> DataFrame:
        tokens = F.col("tokens")
        rows = rows.select("doc_id", "u", F.when(held(tokens, enough), tokens).alias("tokens"))
        places = F.sequence(F.lit(1), F.size(tokens))
        starts = F.filter(places, lambda p: ~mark(F.get(tokens, p - 1)) & ((p == 1) | F.coalesce(mark(F.get(tokens, p - 2)), F.lit(True))))
        rows = rows.withColumn("starts", F.when(F.size(tokens) > 0, starts))
        # Between two words there is one mark at most.
        window = lambda p: F.slice(tokens, p, F.lit(2 * most))
        rows = rows.withColumn("starts", F.filter("starts", lambda p: held(window(p), enough)))

        def from_start(w: Column) -> Column:
            ends = F.filter(F.sequence(F.lit(1), F.size(w)), lambda e: F.coalesce(mark(F.get(w, e)), F.lit(True)) & ~mark(F.get(w, e - 1)))
            lines = F.transform(ends, lambda e: words(F.slice(w, F.lit(1), e)))
            return F.transform(F.filter(lines, lambda a: F.size(a).between(2, most)), _pairs)

        found = F.flatten(F.transform(F.transform("starts", window), from_start))
        return rows.select("doc_id", F.when(F.size("starts") > 0, F.concat("u", found)).otherwise(F.col("u")).alias("u"))

    return near, step


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _greatest(cols: list[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.greatest(*cols)
