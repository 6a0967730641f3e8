"""Licence scans by the Dice coefficient over word bigrams, on DataFrame functions only.

A text is scanned in units: each of its lines, and the whole text where that has several lines. A unit of n distinct bigrams can
reach a Dice coefficient t with a template of m bigrams only if t / (2 - t) * m <= n <= (2 - t) / t * m: those bounds prune units before
their bigrams are made, and templates before they are compared.

Notices that are wrapped, or lie inside a longer line, are found as passages: runs of words of any length up to (2 - t) / t times the
template's, anywhere in the text. A best run starts and ends with a bigram of the template, so only those are scored. Texts are
cut into blocks that overlap by the longest run, so that no row holds more than a block.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Whole licence texts (without title and copyright line) and the notices that their stewards ask for, and short statements that stand in for one.
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD3_TEXT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
UNLICENSE_TEXT = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>"""
ZLIB_TEXT = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
TEMPLATES = [
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", BSD3_TEXT),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", ISC_TEXT),
    ("ISC", ISC_TEXT.partition("\n")[0]),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", MIT_TEXT),
    ("MIT", MIT_TEXT.partition("\n")[0]),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", UNLICENSE_TEXT),
    ("Unlicense", UNLICENSE_TEXT.partition("\n")[0]),
    ("Zlib", ZLIB_TEXT),
]

THRESHOLD = 0.8

#: Bigrams in which the runs of one block of a text start.
BLOCK = 1024
WORD = r"([a-z0-9]+(?:\.[0-9]+)*)"


def normalised(text: str) -> list[str]:
    """The words of a template, by the rule that the columns follow: a-z and 0-9 runs, dots inside a number kept."""
    return re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", text.lower())


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def anchors(sized: list[tuple[str, list[str]]], low: float) -> list[str]:
    """Words of which every match contains one.

    A match shares at least low * m of a template's m bigrams, so of any m - ceil(low * m) + 1 of them it has one. Words are
    chosen, long ones first, until the bigrams that hold a chosen word are as many in each template.
    """
    chosen: list[str] = []
    short = lambda grams: len(grams) - math.ceil(low * len(grams)) + 1 - sum(any(w in g.split() for w in chosen) for g in grams)
    while open_ := [grams for _, grams in sized if short(grams) > 0]:
        gain = Counter(w for grams in open_ for g in grams if not any(c in g.split() for c in chosen) for w in set(g.split()))
        chosen.append(max(gain, key=lambda w: (min(len(w), 6), gain[w], w)))
    return chosen


def _bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))


def _listed(sized: list[tuple[str, list[str]]], longest: list[int]) -> Column:
    grams = lambda own: F.array(*(F.lit(x) for x in own))
    return F.array(*(F.struct(F.lit(name).alias("license"), F.lit(len(g)).alias("m"), F.lit(n).alias("longest"), grams(g).alias("t_grams")) for (name, g), n in zip(sized, longest, strict=True)))


def _passages(texts: DataFrame, listed: Column, longest: int, low: float, threshold: float) -> DataFrame:
    """For each bigram of a text at which a run begins that matches a template: the best run (of equal ones the shortest), by its first and last bigram and line."""
    inside = lambda a: F.transform(a, lambda p: p["gram"])
    words = F.transform(F.split("lowered", "\n"), lambda line, i: F.transform(F.regexp_extract_all(line, F.lit(WORD), F.lit(1)), lambda w: F.struct(w.alias("word"), i.alias("line"))))
    worded = texts.select("_key", "_text", F.explode(F.array(F.flatten(words))).alias("words")).where(F.size("words") > 1)
    n = F.size("words") - 1
    pairs = F.zip_with(F.slice("words", F.lit(1), n), F.slice("words", F.lit(2), n), lambda a, b: F.struct(F.concat_ws(" ", a["word"], b["word"]).alias("gram"), a["line"].alias("first"), b["line"].alias("last")))
    paired = worded.select("_key", "_text", F.explode(F.array(pairs)).alias("all"))
    cut = F.transform(F.sequence(F.lit(0), F.size("all") - 1, F.lit(BLOCK)), lambda at: F.struct(at.alias("at"), F.slice("all", at + 1, F.lit(BLOCK + longest)).alias("pairs")))
    blocks = paired.select("_key", "_text", F.inline(cut)).select("_key", "_text", "at", "pairs", F.explode(F.array(inside(F.col("pairs")))).alias("grams"))
    near = blocks.select("_key", "_text", "at", "pairs", "grams", F.explode(F.filter(listed, lambda t: F.size(F.array_intersect(t["t_grams"], F.col("grams"))) >= t["m"] * low)).alias("t"))
    # where each bigram of a block was last before: of a run from s on, those whose last place is before s are the distinct ones
    ordered = near.select("_key", "_text", "at", "pairs", "t", F.explode(F.array(F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("gram"), i.alias("i")))))).alias("o"))
    shifted = F.concat(F.array(F.lit(None).cast("struct<gram:string,i:int>")), F.slice("o", F.lit(1), F.size("o") - 1))
    before = F.zip_with("o", shifted, lambda a, b: F.struct(a["i"].alias("i"), F.when(a["gram"] == b["gram"], b["i"]).otherwise(-1).alias("prev")))
    placed = ordered.select("_key", "_text", "at", "pairs", "t", F.explode(F.array(F.array_sort(before))).alias("before"))
    mark = F.zip_with("pairs", "before", lambda p, v: F.struct(p["first"].alias("first"), p["last"].alias("last"), v["prev"].alias("prev"), F.array_contains("t.t_grams", p["gram"]).alias("hit")))
    marked = placed.select("_key", "_text", "at", "t.license", "t.m", "t.longest", F.explode(F.array(mark)).alias("marks"))
    # a run that matches has ceil(low * m) hits at least: only hits that are followed by as many within the longest run can begin one
    hits = marked.select("*", F.explode(F.array(F.filter(F.sequence(F.lit(1), F.size("marks")), lambda i: F.get("marks", i - 1)["hit"]))).alias("hits"))
    ahead = F.transform("hits", lambda p, j: F.struct(p.alias("p"), F.get("hits", j + F.ceil(F.col("m") * low).cast("int") - 1).alias("enough")))
    starts = F.transform(F.filter(ahead, lambda h: (h["p"] <= BLOCK) & (h["enough"] - h["p"] < F.col("longest"))), lambda h: h["p"])

    def best_run(start: Column) -> Column:
        """The best end of the runs from a start on, in one pass: how many distinct bigrams and how many of the template's there are up to each."""
        first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("hits"), F.lit(0).alias("size"), F.struct(F.lit(-1.0).alias("dice"), F.lit(0).alias("minus"), F.lit(-1).alias("last")).alias("best"))

        def step(a: Column, x: Column) -> Column:
            new = x["prev"] < start - 1
            n, hits, size = a["n"] + new.cast("int"), a["hits"] + (new & x["hit"]).cast("int"), a["size"] + 1
            dice = F.when(x["hit"] & (size >= F.ceil(F.col("m") * low)), 2.0 * hits / (n + F.col("m"))).otherwise(-1.0)
            return F.struct(n.alias("n"), hits.alias("hits"), size.alias("size"), F.greatest(a["best"], F.struct(dice.alias("dice"), (-size).alias("minus"), x["last"].alias("last"))).alias("best"))

        return F.aggregate(F.slice("marks", start, F.col("longest")), first, step, lambda a: a["best"])

    found = F.transform(starts, lambda i: F.struct((F.col("at") + i).alias("start"), F.get("marks", i - 1)["first"].alias("first"), best_run(i).alias("best")))
    runs = hits.select("_key", "_text", "license", F.explode(F.array(found)).alias("found")).select("_key", "_text", "license", F.inline("found"))
    return runs.where(F.col("best.dice") >= threshold).select("_key", "_text", "license", F.struct("start", (F.col("start") - F.col("best.minus") - 1).alias("end"), "best.dice", "first", "best.last").alias("passage"))


def _apart(runs: str) -> Column:
    """Of runs in the order of their starts, one of each set that overlaps: the best, of equal ones the first."""
    c = F.col(runs)
    first = F.struct(F.get(c, F.lit(0)).alias("now"), F.slice(c, F.lit(1), F.lit(0)).alias("done"))

    def step(a: Column, x: Column) -> Column:
        new = F.struct(x.alias("now"), F.concat(a["done"], F.array(a["now"])).alias("done"))
        same = F.struct(F.when(x["dice"] > a["now"]["dice"], x).otherwise(a["now"]).alias("now"), a["done"].alias("done"))
        return F.when(x["start"] > a["now"]["end"], new).otherwise(same)

    return F.when(F.size(c) > 0, F.aggregate(c, first, step, lambda a: F.concat(a["done"], F.array(a["now"])))).otherwise(c)


def scan_licenses(df: DataFrame, text: str = "text", key: str = "doc_id", templates=tuple(TEMPLATES), threshold: float = THRESHOLD) -> DataFrame:
    """One row per key and licence: license, n_units (units that match it), first_unit (the first line, from 0; -1: the whole text), dice (the best, rounded to 6).

    Units are lines, whole texts of several lines, and passages: a notice over several lines or inside a line counts for the line in
    which it begins, unless it touches a line that matches the licence itself or the whole text does. Of passages that overlap the best counts.
    Null and empty texts and texts without a match give no row. Of several templates of a licence the best counts for a unit. Rows
    that repeat a key are reported once, each unit number counted once. A null key is a key. Extra columns are ignored. The whole
    text is scanned, however long. Templates are an argument held by the driver; they become literals of the plan. The
    shuffles carry matches.
    """
    sized = [(name, bigrams(normalised(t)), len(normalised(t)) - 1) for name, t in templates]
    sized = [(name, grams, n) for name, grams, n in sized if grams]
    sized, lengths = [x[:2] for x in sized], [x[2] for x in sized]
    # a little wide: rounding must not prune what reaches the threshold exactly
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9
    least, most = min(len(g) for _, g in sized) * low, max(len(g) for _, g in sized) * high
    longest = [math.floor(n * high) for n in lengths]
    listed = _listed(sized, longest)
    lowered = F.lower(F.col(text))
    numbered = lambda c, first: F.transform(c, lambda line, i: F.struct((i + first).alias("unit"), line.alias("line")))
    parts = F.concat(numbered(F.split(lowered, "\n"), 0), F.when(F.contains(F.col(text), F.lit("\n")), numbered(F.array(lowered), -1)).otherwise(F.expr("array()")))
    anchored = lambda c: functools.reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in anchors(sized, low)))
    # each generator below keeps the filters that follow from being merged into the expressions before it, which would repeat those
    texts = df.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_text"), F.col(text), F.explode(F.array(lowered)).alias("lowered")).where(anchored("lowered"))
    units = texts.select("_key", "_text", F.inline(parts))
    likely = units.where(anchored("line"))
    worded = likely.select("_key", "_text", "unit", F.explode(F.array(F.regexp_extract_all("line", F.lit(WORD), F.lit(1)))).alias("words")).where(F.size("words") > least)
    grams = worded.select("_key", "_text", "unit", F.explode(F.array(_bigrams(F.col("words")))).alias("grams")).where(F.size("grams").between(F.lit(least), F.lit(most)))
    near = F.filter(listed, lambda t: F.size("grams").between(t["m"] * low, t["m"] * high))
    scored = grams.select("_key", "_text", "unit", "grams", F.explode(near).alias("t")).select(
        "_key", "_text", "unit", "t.license", (2.0 * F.size(F.array_intersect("grams", "t.t_grams")) / (F.size("grams") + F.col("t.m"))).alias("dice")
    )
    whole = scored.where(F.col("dice") >= threshold).select("_key", "_text", "license", F.struct("unit", "dice").alias("whole"))
    both = whole.unionByName(_passages(texts.select("_key", "_text", "lowered"), listed, max(longest), low, threshold), allowMissingColumns=True)
    # sets, not lists: copies of a row add nothing
    found = both.groupBy("_key", "_text", "license").agg(F.collect_set("whole").alias("wholes"), F.sort_array(F.collect_set("passage")).alias("runs"))
    touched = lambda p: F.exists("wholes", lambda w: (w["unit"] == -1) | w["unit"].between(p["first"], p["last"]))
    passages = F.transform(F.filter(_apart("runs"), lambda p: ~touched(p)), lambda p: F.struct(p["first"].alias("unit"), p["dice"].alias("dice")))
    return (
        found.select("_key", "license", F.inline(F.concat("wholes", passages)))
        .groupBy(F.col("_key").alias(key), "license")
        .agg(F.count_distinct("unit").cast("long").alias("n_units"), F.min("unit").alias("first_unit"), F.round(F.max("dice"), 6).alias("dice"))
    )


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_QUOTED = ", ".join("({}, '{}', '{}')".format(i, name, t.replace("'", "''")) for i, (name, t) in enumerate(TEMPLATES))
#: Lines and whole texts; the words and bigrams of the templates are cut here too, by the same rule as those of the documents.
ORACLE = f"""
WITH given(tid, license, text) AS (VALUES {_QUOTED}),
cut AS (SELECT tid, license, regexp_extract_all(lower(text), '[a-z0-9]+(?:\\.[0-9]+)*') AS w FROM given),
t AS (SELECT DISTINCT tid, license, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT tid, license, w, unnest(range(1, len(w))) AS i FROM cut)),
sizes AS (SELECT tid, count(*) AS m FROM t GROUP BY tid),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS unit FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, text, -1 FROM documents WHERE contains(text, chr(10))),
worded AS (SELECT doc_id, unit, regexp_extract_all(lower(line), '[a-z0-9]+(?:\\.[0-9]+)*') AS w, row_number() OVER () AS u FROM lines),
grams AS (SELECT DISTINCT u, doc_id, unit, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT u, doc_id, unit, w, unnest(range(1, len(w))) AS i FROM worded WHERE len(w) > 1)),
n AS (SELECT u, count(*) AS n FROM grams GROUP BY u),
score AS (
  SELECT g.u, g.doc_id, g.unit, t.license, 2.0::DOUBLE * count(*) / (any_value(n.n) + any_value(sizes.m)) AS dice
  FROM grams g JOIN t USING (gram) JOIN sizes USING (tid) JOIN n USING (u) GROUP BY g.u, g.doc_id, g.unit, t.tid, t.license)
SELECT doc_id, license, count(DISTINCT unit) AS n_units, min(unit)::INT AS first_unit, round(max(dice), 6) AS dice
FROM score WHERE dice >= {THRESHOLD} GROUP BY doc_id, license
"""
