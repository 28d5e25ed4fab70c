"""Licence scan of a file tree: TF-IDF cosine to templates, then inheritance from the nearest directory, in DataFrame expressions only.

A file's units are its lines, its blocks (runs of lines without a blank one, as headers are) and, if its name says that it is a licence file, its whole
text. Terms are runs of a-z and 0-9 of the lower-case text; their weight in a unit is 1 + ln(count) times ln((1 + N) / (1 + n)) + 1, where n of the N
files hold the term (0 for terms that no template has). Templates are notices of a line, headers and short licences of a block, and whole licences; each is compared with
units of its own kind and of the larger ones. A file's own licence is that of the highest cosine of at least THRESHOLD, where the whole text of a licence file counts
before its blocks, and those before lines: a licence may quote another one's name, header or clauses.

Pruning. Sort a template's terms by weight; once the terms that are left over have a norm below THRESHOLD, a unit without any of the terms
before them can't reach it (Cauchy-Schwarz). So only files with one of those terms are cut into lines and blocks, and only such units are vectorised, each different one
once. Likewise a unit of m terms can't reach a template whose m heaviest terms have a norm below THRESHOLD.

Inheritance. A file without a licence of its own takes that of the nearest directory above it that has a licence file with one: each
different directory is joined with the licensed ones on all its ancestors, and files are joined with their directory.

Defined results: null and blank texts have no units; a text is read as a whole, however long, as an array of terms in its row; ties go to the smaller licence id; of several
licence files in a directory the highest cosine counts; repeated rows are scanned alike, and rows that repeat an id and path take the best of their licences; a null id is an id;
a null path has no directory, so it inherits nothing; an empty table gives an empty result; columns of the input other than id, path and text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import join_hot_aware, written

THRESHOLD = 0.6
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"
LINE, BLOCK, WHOLE = 0, 1, 2

#: Short forms of common notices, under their SPDX ids.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "CC0 1.0 Universal: no rights reserved, dedicated to the public domain"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)

#: Licences of a few paragraphs and the headers that licences ask for, under their SPDX ids.
HEADERS = (
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
        the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    ),
    (
        "EPL-2.0",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
        https://www.eclipse.org/legal/epl-2.0/""",
    ),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one
        at https://mozilla.org/MPL/2.0/.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
        this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
        RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
        in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
        OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE.""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either
        in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
        authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
        the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
        under copyright law.""",
    ),
)

#: The parts that BSD licences and the GNU licences' headers are made of.
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
    materials provided with the distribution."""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific
    prior written permission."""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
    MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
    SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
    HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
    SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
GNU_GRANT = """This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either
    version {version} of the License, or (at your option) any later version."""
GNU_REST = """This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
    PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {what}. If not, see https://www.gnu.org/licenses/."""
GNU = (
    ("AGPL-3.0", "program", "Affero General Public License", "3"),
    ("GPL-2.0", "program", "General Public License", "2"),
    ("GPL-3.0", "program", "General Public License", "3"),
    ("LGPL-2.1", "library", "Lesser General Public License", "2.1"),
    ("LGPL-3.0", "library", "Lesser General Public License", "3"),
)
#: Fixed value: what the Affero licence has for the section on use with it.
AFFERO = """Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified version
    must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding
    Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of
    software."""
#: Ids that a line "SPDX-License-Identifier: <id>" may name.
IDS = tuple(
    "AGPL-3.0 Apache-2.0 Artistic-1.0 BSD-2-Clause BSD-3-Clause CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0 MIT MPL-2.0 Unlicense".split()
)
TEXTS = Path(__file__).parent / "licence_texts"


@functools.cache
def templates() -> tuple[tuple[str, int, str], ...]:
    """(licence, kind, text) of all templates: the notices and headers above, and the whole licences that lie beside this module."""
    out = [(licence, LINE, text) for licence, text in NOTICES]
    out += [(licence, LINE, f"SPDX-License-Identifier: {licence}") for licence in IDS]
    out += [(licence, BLOCK, text) for licence, text in HEADERS]
    out += [("BSD-2-Clause", BLOCK, f"{BSD_HEAD} {BSD_TAIL}"), ("BSD-3-Clause", BLOCK, f"{BSD_HEAD} {BSD_NAMES} {BSD_TAIL}")]
    for licence, what, name, version in GNU:
        grant, rest = (part.format(what=what, name=name, version=version) for part in (GNU_GRANT, GNU_REST))
        out += [(licence, BLOCK, grant), (licence, BLOCK, f"{grant} {rest}")]
    whole = {path.stem: path.read_text(encoding="utf-8") for path in sorted(TEXTS.glob("*.txt"))}
    out += [(licence, WHOLE, text) for licence, text in whole.items()]
    affero = whole["GPL-3.0"].replace("GNU General Public License", "GNU Affero General Public License").replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE")
    out.append(("AGPL-3.0", WHOLE, f"{affero} {AFFERO}"))
    return tuple(out)


def terms(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


@functools.cache
def template_rows() -> tuple[tuple[int, str, int, str, int], ...]:
    """(template, licence, kind, term, count)."""
    out = []
    for k, (licence, kind, text) in enumerate(templates()):
        counts: dict[str, int] = {}
        for t in terms(text):
            counts[t] = counts.get(t, 0) + 1
        out += [(k, licence, kind, t, n) for t, n in sorted(counts.items())]
    return tuple(out)


def term_weights(files: DataFrame, text_col: str = "text") -> tuple[dict[str, float], float]:
    """The weight of every template term, counted over all files, and that of any other term."""
    known = sorted({r[3] for r in template_rows()})
    side = F.broadcast(files.sparkSession.createDataFrame([(t,) for t in known], "term string"))  # the templates' terms
    held = files.select(F.explode(F.array_distinct(_terms(F.col(text_col).cast("string")))).alias("term"))
    counts = held.join(side, "term").groupBy("term").agg(F.count("*").alias("n"))
    found = {r["term"]: r["n"] for r in counts.collect()}  # a row per template term at most
    total = files.count()
    return {t: math.log((1 + total) / (1 + found.get(t, 0))) + 1 for t in known}, math.log(1 + total) + 1


def vectors_of(weights: dict[str, float]) -> list[tuple[str, int, list[tuple[float, str]]]]:
    """(licence, kind, [(weight, term)]) of every template, of norm 1 and heaviest first."""
    by: dict[int, list[tuple[float, str]]] = {}
    for k, _, _, t, n in template_rows():
        by.setdefault(k, []).append(((1 + math.log(n)) * weights[t], t))
    out = []
    for k, (licence, kind, _) in enumerate(templates()):
        norm = math.sqrt(sum(w * w for w, _ in by[k]))
        out.append((licence, kind, sorted(((w / norm, t) for w, t in by[k]), reverse=True)))
    return out


def needed_terms(vectors: list[tuple[str, int, list[tuple[float, str]]]], threshold: float = THRESHOLD) -> list[str]:
    """Terms of which a line or block must have one to reach the threshold with any template for those."""
    out: set[str] = set()
    for _, kind, vector in vectors:
        if kind < WHOLE:
            left = 1.0
            for w, t in vector:
                if math.sqrt(max(left, 0)) < threshold - 1e-9:
                    break
                out.add(t)
                left -= w * w
    return sorted(out)


def least_terms(vector: list[tuple[float, str]], threshold: float = THRESHOLD) -> int:
    """The different terms that a unit must have at least to reach the threshold with a template."""
    held = 0.0
    for m, (w, _) in enumerate(vector, 1):
        held += w * w
        if math.sqrt(held) >= threshold - 1e-9:
            return m
    return len(vector)


def own_licences(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, path, licence, cosine) of the files (id, path, text) that have a licence of their own."""
    spark: SparkSession = files.sparkSession
    weights, other = term_weights(files)
    vectors = vectors_of(weights)
    needed = F.array(*map(F.lit, needed_terms(vectors, threshold)))
    text = F.col("text").cast("string")
    is_licence = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    slim = files.select("id", "path", text.alias("text"), is_licence.alias("whole"))
    some = slim.where(F.col("whole") | F.arrays_overlap(_terms(F.col("text")), needed))
    unit = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("unit"))
    lines = F.transform(F.array_distinct(F.split("text", "\n")), lambda x: unit(LINE, x))
    blocks = F.transform(F.array_distinct(F.split("text", "\n[ \t\r]*\n")), lambda x: unit(BLOCK, x))
    every = F.concat(lines, blocks, F.when(F.col("whole"), F.array(unit(WHOLE, F.col("text")))).otherwise(F.array().cast("array<struct<kind:int,unit:string>>")))
    parts = some.select("id", "path", F.explode(every).alias("u")).select("id", "path", "u.kind", "u.unit")
    units = written(
        parts.where((F.col("kind") == WHOLE) | F.arrays_overlap(_terms(F.col("unit")), needed)).withColumn("key", F.sha2(F.concat(F.col("kind").cast("string"), "unit"), 256)),
        "units",
    )
    unlike = units.groupBy("key").agg(F.first("kind").alias("kind"), F.first("unit").alias("unit"), F.count("*").alias("n"))
    weighed = F.broadcast(spark.createDataFrame([*weights.items()], "term string, weight double"))  # the templates' terms
    counted = unlike.select("key", "kind", F.explode(_terms(F.col("unit"))).alias("term")).groupBy("key", "kind", "term").agg(F.count("*").alias("tf"))
    heavy = (1 + F.log("tf")) * F.coalesce("weight", F.lit(other))
    weighted = written(counted.join(weighed, "term", "left").select("key", "kind", "term", heavy.alias("w"), F.col("weight").isNotNull().alias("known")), "vectors")
    norms = weighted.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.count_if("known").cast("int").alias("m"))
    scaled = [(k, licence, kind, least_terms(vector, threshold), t, w) for k, (licence, kind, vector) in enumerate(vectors) for w, t in vector]
    sides = F.broadcast(spark.createDataFrame(scaled, "template int, licence string, size int, least int, term string, t double"))  # the templates
    terms_of = weighted.where("known").join(norms, "key")
    fits = (F.col("a.term") == F.col("b.term")) & (F.col("a.kind") >= F.col("b.size")) & (F.col("a.m") >= F.col("b.least"))
    dots = terms_of.alias("a").join(sides.alias("b"), fits).groupBy("key", "kind", "norm", "template", "licence").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    best = (
        dots.withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6))
        .where(F.col("cosine") >= threshold)
        .groupBy("key")
        .agg(F.min(F.struct((-F.col("kind")).alias("kind"), (-F.col("cosine")).alias("m"), "licence")).alias("b"))
        .join(unlike.select("key", "n"), "key")
        .select("key", "b", "n")
    )
    found = join_hot_aware(units, written(best, "best"), "key", "n", units.count())
    return found.groupBy("id", "path").agg(F.min("b").alias("b")).select("id", "path", F.col("b.licence").alias("licence"), (-F.col("b.m")).alias("cosine"))


def directory(path):
    """The path up to its last slash; empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, path, licence, cosine, origin, licence_dir) of every file of files (id, path, text); origin is own, inherited or none."""
    own = written(own_licences(files, threshold), "own")
    slim = files.select("id", "path", directory(F.col("path")).alias("dir"))
    given = own.where(F.col("path").rlike(LICENCE_FILE)).groupBy(directory(F.col("path")).alias("up")).agg(
        F.min(F.struct((-F.col("cosine")).alias("m"), "licence")).alias("b")
    )
    dirs = written(slim.where(F.col("dir").isNotNull()).groupBy("dir").agg(F.count("*").alias("n")), "dirs")
    steps = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("k")).select(
        "dir", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("k")), "/").alias("up"), "k"
    )
    above = written(above.groupBy("dir", "up").agg(F.max("k").alias("k")), "above")
    sizes = above.groupBy("up").agg(F.count("*").alias("n_dirs"))
    lines = join_hot_aware(above, written(given.join(sizes, "up"), "given"), "up", "n_dirs", above.count())
    nearest = lines.groupBy("dir").agg(F.max(F.struct("k", "up", "b")).alias("near")).join(dirs, "dir")
    total = dirs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = join_hot_aware(slim, written(nearest, "nearest"), "dir", "n", total, "left")
    mine = own.select(F.col("id").alias("_id"), F.col("path").alias("_path"), F.col("licence").alias("_licence"), F.col("cosine").alias("_cosine"))
    both = placed.join(mine, F.col("id").eqNullSafe(F.col("_id")) & F.col("path").eqNullSafe(F.col("_path")), "left")
    has, heir = F.col("_licence").isNotNull(), F.col("near").isNotNull()
    return both.select(
        "id",
        "path",
        F.coalesce("_licence", "near.b.licence").alias("licence"),
        F.coalesce("_cosine", -F.col("near.b.m")).alias("cosine"),
        F.when(has, "own").when(heir, "inherited").otherwise("none").alias("origin"),
        F.when(~has & heir, F.col("near.up")).alias("licence_dir"),
    )
