"""License scan: Dice coefficient over word bigrams against licence templates, with DataFrame functions only.

The units of a text are its lines, its paragraphs of several lines (between blank lines) and the text as a whole, so
that a notice wrapped over lines is found inside a longer document. A unit of n bigrams can reach a Dice
coefficient of t only against templates of n t / (2 - t) to n (2 - t) / t bigrams. Three bounds follow from
this, none of which loses a match: texts and units that hold none of a few words of the templates
(`anchors`) are left as they are, units outside all sizes are pruned, and so are those of
which fewer than n t / (2 - t) bigrams stand in any template. Only what is left becomes rows. The
template table is a fixed list in this file, with texts of a bounded folder if wanted
(`read_templates`), so its bigrams are broadcast.

Defined cases: a null or blank text matches nothing; a unit of one word has no bigram and is compared
as that word; of equal coefficients the first licence by name wins, then the first unit; rows that
repeat a doc_id are one document with the units of all, those of one place and
the same words once; a null key is a key; an empty table gives an empty result; the output has one row per key,
without the other columns.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landmatch.llm.quality import STOP_WORDS

LEAST = 0.8
PARAGRAPH = r"\n[ \t]*\n"
#: Of licence texts read from a folder; they are broadcast.
MAX_TEMPLATE_BYTES = 8 << 20

# The passages by which works carry or name their licence.
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_CLAUSES = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
APACHE_HEADER = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."


def gnu_header(name: str, version: str) -> str:
    """The notice at the head of a file under one of the GNU licences."""
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


def gnu_warranty(name: str) -> str:
    return f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."


GNU = {"GPL-2.0": ("General Public License", "2"), "GPL-3.0": ("General Public License", "3"), "LGPL-2.1": ("Lesser General Public License", "2.1"), "LGPL-3.0": ("Lesser General Public License", "3"), "AGPL-3.0": ("Affero General Public License", "3")}

TEMPLATES = (
    *((licence, gnu_header(name, version)) for licence, (name, version) in GNU.items()),
    *((licence, f"{gnu_header(name, version)} {gnu_warranty(name)}") for licence, (name, version) in GNU.items()),
    ("Apache-2.0", APACHE_HEADER),
    ("BSD-2-Clause", f"{BSD_HEAD} {BSD_CLAUSES}"),
    ("BSD-2-Clause", f"{BSD_HEAD} {BSD_CLAUSES} {BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{BSD_HEAD} {BSD_CLAUSES} {BSD_THIRD}"),
    ("BSD-3-Clause", f"{BSD_HEAD} {BSD_CLAUSES} {BSD_THIRD} {BSD_WARRANTY}"),
    ("BSD-3-Clause", BSD_THIRD),
    ("ISC", ISC_GRANT),
    ("MIT", MIT_GRANT),
    ("MIT", f"{MIT_GRANT} {MIT_NOTICE}"),
    ("MIT", f"{MIT_GRANT} {MIT_NOTICE} {MIT_WARRANTY}"),
    ("MIT", f"MIT License {MIT_GRANT} {MIT_NOTICE} {MIT_WARRANTY}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", UNLICENSE),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) < 2, words).otherwise(pairs)


def template_bigrams(templates) -> list[tuple[int, str, int, str, int]]:
    """(template, licence, its bigrams, bigram, times)."""
    out = []
    for k, (name, notice) in enumerate(templates):
        words = re.findall(r"[a-z0-9]+", notice.lower())
        grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)] or words
        out += [(k, name, len(grams), g, n) for g, n in Counter(grams).items()]
    return out


def anchors(templates=TEMPLATES, least: float = LEAST) -> list[str]:
    """Words of which every unit that is similar to a template holds at least one, as a part of a word.

    A unit of Dice ``least`` shares at least t * least / (2 - least) of a template's t bigrams. So if more than the
    others hold an anchor, the shared ones cannot all be without. Words of five characters or more that are no stop words are taken first, as they are rarer elsewhere.
    """
    wide = least / (2 - least)
    notices = []
    for _, notice in templates:
        words = re.findall(r"[a-z0-9]+", notice.lower())
        grams = [(a, b) for a, b in zip(words, words[1:], strict=False)] or [(w,) for w in words]
        notices.append((grams, len(grams) - math.ceil(len(grams) * wide - 1e-9) + 1))
    chosen: list[str] = []
    while True:
        open_ = [(grams, need - sum(any(c in w for c in chosen for w in g) for g in grams)) for grams, need in notices]
        gain: Counter = Counter()
        for grams, need in open_:
            if need > 0:
                bare = [g for g in grams if not any(c in w for c in chosen for w in g)]
                for word in {w for g in bare for w in g}:
                    gain[word] += min(need, sum(any(word in w for w in g) for g in bare))
        if not gain:
            return sorted(chosen)
        chosen.append(max(sorted(gain), key=lambda w: (w not in STOP_WORDS, min(len(w), 5), gain[w] * len(w))))


def read_templates(spark: SparkSession, path: str) -> tuple[tuple[str, str], ...]:
    """(name, text) of every file below ``path``, named by the file, to be added to TEMPLATES: whole licence texts.

    The table is held by the driver and broadcast, so folders of more than MAX_TEMPLATE_BYTES are an error.
    """
    files = spark.read.format("binaryFile").load(path)
    size = files.agg(F.sum("length")).first()[0] or 0
    if size > MAX_TEMPLATE_BYTES:
        raise ValueError(f"{size} bytes of licence texts are more than {MAX_TEMPLATE_BYTES}")
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "UTF-8").alias("notice"))
    return tuple((r.name, r.notice) for r in named.orderBy("name").collect())


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, templates=TEMPLATES) -> DataFrame:
    """(key, line, unit, license, dice): every unit's best licence of at least ``least``; line is -1 for the whole text and -2, -3 .. for its first, second .. paragraph; unit is a hash of its words."""
    spark = docs.sparkSession
    rows = template_bigrams(templates)
    known = F.broadcast(spark.createDataFrame(rows, "template int, license string, t_size int, gram string, t_times int"))
    sizes = sorted({r[2] for r in rows})
    wide = least / (2 - least)
    marks = anchors(templates, least)
    holds = lambda low: reduce(operator.or_, [F.contains(low, F.lit(w)) for w in marks])

    # texts and units without an anchor are left before any word is cut; of n characters are at most n / 2 words
    low = docs.select(F.col(key), F.lower(F.col(text)).alias("_text")).where(F.exists(F.array(F.lower(F.col(text))), holds))
    unit = "array<struct<line:int,unit:string>>"
    lines, split = F.split("_text", "\n"), F.split("_text", PARAGRAPH)
    whole = F.when(F.contains("_text", F.lit("\n")), F.array(F.struct(F.lit(-1).alias("line"), F.col("_text").alias("unit")))).otherwise(F.array().cast(unit))
    several = F.filter(F.transform(split, lambda x, k: F.struct((-2 - k).alias("line"), x.alias("unit"))), lambda p: p["unit"].contains("\n"))
    paragraphs = F.when(F.size(split) > 1, several).otherwise(F.array().cast(unit))
    units = F.concat(whole, paragraphs, F.transform(lines, lambda x, k: F.struct(k.alias("line"), x.alias("unit"))))
    each = low.select(key, F.explode(F.filter(units, lambda u: (F.length(u["unit"]) >= 2 * sizes[0] * wide) & holds(u["unit"]))).alias("u"))
    words = each.select(key, "u.line", F.array_remove(F.split("u.unit", "[^a-z0-9]+"), "").alias("w")).where(F.size("w") > 0)
    sized = words.withColumn("n", F.greatest(F.size("w") - 1, F.lit(1)))
    bounded = sized.where((F.col("n") >= sizes[0] * wide) & (F.col("n") <= sizes[-1] / wide))
    # a unit that is similar to a template has n * wide bigrams or more that stand in one
    grams = sorted({r[3] for r in rows})
    held = bounded.select(key, "line", "n", F.xxhash64(F.array_join("w", " ")).alias("unit"), F.filter(bigrams(F.col("w")), lambda g: g.isin(grams)).alias("_grams"))
    enough = held.where(F.size("_grams") >= F.col("n") * wide - 1e-9).dropDuplicates([key, "line", "unit"])
    met = enough.select(key, "line", "unit", "n", F.explode("_grams").alias("gram")).join(known, "gram")
    pruned = met.where((F.col("n") >= F.col("t_size") * wide) & (F.col("n") * wide <= F.col("t_size")))
    shared = pruned.groupBy(key, "line", "unit", "n", "template", "license", "t_size", "gram", "t_times").agg(F.count("*").alias("times"))
    dice = shared.groupBy(key, "line", "unit", "n", "template", "license", "t_size").agg((2 * F.sum(F.least("times", "t_times")) / (F.col("n") + F.col("t_size"))).alias("dice"))
    best = F.min_by(F.struct("license", "dice"), F.struct(-F.col("dice"), F.col("license")))
    return dice.where(F.col("dice") >= least).groupBy(key, "line", "unit").agg(best.alias("b")).select(key, "line", "unit", "b.license", "b.dice")


def licences(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, templates=TEMPLATES) -> DataFrame:
    """(key, n_matches, license, line, dice): one row per key; the best match, nulls where there is none."""
    found = scan(docs, key, text, least, templates)
    best = F.min_by(F.struct("license", "line", "dice"), F.struct(-F.col("dice"), F.col("license"), F.col("line")))
    per = found.groupBy(key).agg(F.count("*").alias("n_matches"), best.alias("b")).select(F.col(key).alias("_key"), "n_matches", "b.*")
    rows = docs.select(F.col(key)).distinct()
    return rows.join(per, rows[key].eqNullSafe(per["_key"]), "left").select(key, F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), "license", "line", "dice")
