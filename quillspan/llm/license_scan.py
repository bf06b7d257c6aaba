"""License scans [native]: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Units. A header is a line with one of the telling words; it is scored by itself and together with the line after it,
for notices that wrap. A file whose name says so (LICENSE, COPYING and the like) is scored as a whole, too. Each
distinct unit is scored once against every template: one-line notices, longer notices and full licence texts, each version
a template of its own.

Terms are lower-cased runs of letters and digits; idf = ln((1 + N) / (1 + df)) + 1 over the N templates, where a
term that no template has counts with df = 0. A unit's licence is that of the template of highest cosine, if
that is LEAST or more (ties: the smaller name). A file's own licence is that of its best unit. A file
most of whose words stand in such headers, or whose name says so, is a licence file, and speaks for its directory; a file with
no licence of its own has that of the nearest directory above it that has one (path join on every
ancestor of each distinct directory, deepest first; the root is the directory '').

Defined results: a null text has no headers; a null path has no directory and inherits nothing; two
licence files of one directory: the higher score, then the smaller name; repeated rows give repeated
rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, read, settle, small, words

LEAST = 0.6
SALTS = 8
#: Fixed words that make a line a header.
TELLING = r"(?i)\b(licen[sc]e[ds]?|licensing|copyright|spdx|copyleft|public domain)\b"
TERM = "[a-z0-9]+"
#: Fixed names of licence files.
FILE_NAME = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense)(?:[.-][^/]*)?$"
#: Fixed template texts.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright, dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Fixed full texts, without the copyright line.
FULL_TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS
FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use
this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not
claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked
as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the
public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and
future rights to this software under copyright law.""",
}
#: Fixed notices that files carry in place of the full text.
LONG_NOTICES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
General Public License for more details. You should have received a copy of the GNU General Public License along with this program.""",
}


#: Full texts as their stewards publish them, one file each.
TEXT_FOLDER = Path(__file__).resolve().parent / "licenses"


def template_rows() -> list[tuple[str, str, str]]:
    """(name, variant, text) of all templates."""
    rows = [(k, variant, v) for variant, texts in (("notice", TEMPLATES), ("full", FULL_TEXTS), ("long notice", LONG_NOTICES)) for k, v in sorted(texts.items())]
    return rows + [(f.stem, "text", f.read_text(encoding="utf-8")) for f in sorted(TEXT_FOLDER.glob("*.txt"))]


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def score(units: DataFrame, templates: DataFrame, least: float = LEAST) -> DataFrame:
    """(unit, license, score) of the distinct units (unit, text) that come close enough to a template (name, variant, text)."""
    many = templates.count()  # a list written by hand
    key = ["name", "variant"]
    t = templates.select(*key, F.explode(_terms(F.col("text"))).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    df = t.groupBy("term").agg((F.log(F.lit(1.0 + many) / (1 + F.count("*"))) + 1).alias("idf"))
    t = t.join(df, "term").withColumn("w", F.col("tf") * F.col("idf"))
    t = t.join(t.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), key).select(*key, "term", (F.col("w") / F.col("norm")).alias("tw"))
    own = units.select("unit", F.explode(_terms(F.col("text"))).alias("term")).groupBy("unit", "term").agg(F.count("*").alias("tf"))
    own = own.join(small(df), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.log(F.lit(1.0 + many)) + 1))
    norms = own.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = own.join(small(t), "term").groupBy("unit", *key).agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norms, "unit").select("unit", "name", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    best = scored.groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("name").alias("name"))).alias("b"))
    return best.select("unit", F.col("b.name").alias("license"), (-F.col("b.s")).alias("score")).where(F.col("score") >= least)


def _ancestors(directory: Column) -> Column:
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    absolute = F.when(directory.startswith("/"), "/").otherwise("")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.concat(absolute, F.array_join(F.slice(parts, 1, n), "/")).alias("up")))


def _headers(text: Column) -> Column:
    """The lines with a telling word, each with the line after it and whether that is one, too."""
    told = lambda x: F.coalesce(x.rlike(TELLING), F.lit(False))

    def marked(lines: Column) -> Column:
        rows = F.transform(lines, lambda x, i: F.struct(F.btrim(x).alias("line"), F.coalesce(F.btrim(F.get(lines, i + 1)), F.lit("")).alias("next"), told(F.get(lines, i + 1)).alias("told")))
        return F.filter(rows, lambda r: told(r["line"]))

    none = F.array().cast("array<struct<line:string,next:string,told:boolean>>")
    return F.when(text.rlike(TELLING), let(F.split(text, "\n"), marked)).otherwise(none)


def scan(files: DataFrame, templates: DataFrame, least: float = LEAST) -> DataFrame:
    """files (path, text) with license, score, origin (own, inherited or none) and from_dir."""
    text = F.coalesce("text", F.lit(""))
    files = files.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    heads = files.select("path", "dir", F.size(words(F.col("text"))).alias("n"), _headers(text).alias("heads")).where(F.size("heads") > 0)
    heads = settle(heads.withColumn("file", F.monotonically_increasing_id()).select("file", "path", "dir", "n", F.inline("heads")), "headers")
    pair = F.when(F.col("next") == "", F.col("line")).otherwise(F.concat_ws(" ", "line", "next"))
    lines = heads.select(F.col("line").alias("unit")).unionByName(heads.where("next <> ''").select(pair.alias("unit"))).distinct()
    scores = settle(score(lines.withColumn("text", F.col("unit")), templates, least), "scores")
    by = lambda n: small(scores.withColumnsRenamed({"license": f"license{n}", "score": f"score{n}"}))
    found = heads.join(by(1).withColumnRenamed("unit", "line"), "line", "left").withColumn("unit", pair).join(by(2), "unit", "left")
    single, double = F.col("score1").isNotNull(), F.col("score2").isNotNull()
    in_line, in_next = F.size(words(F.col("line"))), F.when(F.col("told"), 0).otherwise(F.size(words(F.col("next"))))
    struct = lambda n: F.when(F.col(f"score{n}").isNotNull(), F.struct((-F.col(f"score{n}")).alias("s"), F.col(f"license{n}").alias("name")))
    found = found.where(single | double).withColumns({"covered": F.when(single, in_line).otherwise(in_line + in_next), "b": F.least(struct(1), struct(2))})
    own = found.groupBy("file").agg(F.first("path").alias("path"), F.first("dir").alias("dir"), F.first("n").alias("n"), F.sum("covered").alias("covered"), F.min("b").alias("b"))
    own = own.select("path", "dir", "b", ((2 * F.col("covered") >= F.col("n")) | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))).alias("is_file"))
    named = files.where(F.col("path").rlike(FILE_NAME)).select("path", "dir", text.alias("text"))
    wholes = score(named.select(F.md5("text").alias("unit"), "text").distinct(), templates, least).select("unit", F.struct((-F.col("score")).alias("s"), F.col("license").alias("name")).alias("b"))
    wholes = named.select("path", "dir", F.md5("text").alias("unit")).join(wholes, "unit").select("path", "dir", "b", F.lit(True).alias("is_file"))
    own = settle(own.unionByName(wholes), "own-licenses")
    speaks = own.where("is_file AND dir IS NOT NULL").groupBy("dir").agg(F.min("b").alias("b"))
    speaks = speaks.select(F.col("dir").alias("up"), F.col("b.name").alias("l"), (-F.col("b.s")).alias("s"))
    # A top directory may hold a third of all directories: the few that speak are repeated for each salt.
    speaks = speaks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dirs = files.select("dir").where("dir IS NOT NULL").distinct().select("dir", F.pmod(F.xxhash64("dir"), F.lit(SALTS)).cast("int").alias("salt"), F.explode(_ancestors(F.col("dir"))).alias("a"))
    dirs = dirs.select("dir", "salt", "a.depth", "a.up").join(speaks, ["up", "salt"]).groupBy("dir").agg(F.max(F.struct("depth", "up", "l", "s")).alias("near"))
    dirs = small(settle(dirs, "near-licenses"))
    own = own.where("path IS NOT NULL").groupBy("path").agg(F.min("b").alias("own"))
    out = files.join(own, "path", "left").join(dirs, "dir", "left")
    mine = F.col("own").isNotNull()
    return out.withColumns(
        {
            "license": F.when(mine, F.col("own.name")).otherwise(F.col("near.l")),
            "score": F.when(mine, -F.col("own.s")).otherwise(F.col("near.s")),
            "origin": F.when(mine, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none"),
            "from_dir": F.when(~mine, F.col("near.up")),
        }
    ).drop("own", "near")


def op4(spark, sf_dir) -> DataFrame:
    """documents as a tree of four depths: by (doc_id div 7) mod 4 one lies in its source, in dN, in pM or in qK below that; every 97th is named LICENSE."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    at = lambda depth, name: F.when(F.pmod(F.floor(F.col("doc_id") / 7), F.lit(4)) >= depth, name)
    folders = (F.concat(F.lit("d"), F.floor(F.col("doc_id") / 1000)), F.concat(F.lit("p"), F.floor(F.col("doc_id") / 50) % 20), F.concat(F.lit("q"), F.floor(F.col("doc_id") / 10) % 5))
    name = F.concat(F.when(F.col("doc_id") % 97 == 0, "LICENSE-").otherwise(""), "doc_id", F.lit(".txt"))
    where = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), *[at(k + 1, folder) for k, folder in enumerate(folders)], name)
    templates = spark.createDataFrame(template_rows(), "name string, variant string, text string")
    return scan(docs.withColumn("path", where), templates).select("doc_id", "path", "license", "score", "origin", "from_dir")


_VALUES = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in template_rows())
_N = len(template_rows())
_TELLING_SQL = r"(?i)\b(licen[sc]e[ds]?|licensing|copyright|spdx|copyleft|public domain)\b"
_COUNT = r"len(regexp_extract_all({}, '[^\x20\x09-\x0D]+'))"
ORACLE_SQL = rf"""
WITH tpl(name, variant, text) AS (VALUES {_VALUES}),
tt AS (SELECT name, variant, term, count(*) AS tf FROM (SELECT name, variant, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM tpl) GROUP BY ALL),
df AS (SELECT term, ln((1.0 + {_N}) / (1 + count(*))) + 1 AS idf FROM tt GROUP BY term),
tw AS (SELECT name, variant, term, tf * idf AS w, sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY name, variant)) AS norm FROM tt JOIN df USING (term)),
f AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, 'unknown') || CASE WHEN doc_id // 7 % 4 >= 1 THEN '/d' || (doc_id // 1000) ELSE '' END || CASE WHEN doc_id // 7 % 4 >= 2 THEN '/p' || (doc_id // 50 % 20) ELSE '' END || CASE WHEN doc_id // 7 % 4 >= 3 THEN '/q' || (doc_id // 10 % 5) ELSE '' END AS dir,
    doc_id % 97 = 0 AS named FROM documents),
h AS (SELECT doc_id, dir, named, {_COUNT.format("t")} AS n, trim(lines[i]) AS line, coalesce(trim(lines[i + 1]), '') AS next, coalesce(regexp_matches(lines[i + 1], '{_TELLING_SQL}'), false) AS told
    FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT *, string_split(t, chr(10)) AS lines FROM f)) WHERE regexp_matches(lines[i], '{_TELLING_SQL}')),
u AS (SELECT DISTINCT line AS unit FROM h UNION SELECT line || ' ' || next FROM h WHERE next <> '' UNION SELECT t FROM f WHERE named),
ut AS (SELECT unit, term, count(*) AS tf FROM (SELECT unit, unnest(regexp_extract_all(lower(unit), '{TERM}')) AS term FROM u) GROUP BY ALL),
uw AS (SELECT unit, term, tf * coalesce(idf, ln(1.0 + {_N}) + 1) AS w FROM ut LEFT JOIN df USING (term)),
un AS (SELECT unit, sqrt(sum(w ** 2)) AS norm FROM uw GROUP BY unit),
sc AS (SELECT uw.unit, tw.name, round(sum(uw.w * tw.w / tw.norm) / any_value(un.norm), 6) AS score FROM uw JOIN tw USING (term) JOIN un ON un.unit = uw.unit GROUP BY uw.unit, tw.name, tw.variant),
bl AS (SELECT unit, name, score FROM sc WHERE score >= {LEAST} QUALIFY row_number() OVER (PARTITION BY unit ORDER BY score DESC, name) = 1),
hits AS (SELECT h.*, CASE WHEN a.unit IS NOT NULL THEN {_COUNT.format("line")} ELSE {_COUNT.format("line")} + CASE WHEN told THEN 0 ELSE {_COUNT.format("next")} END END AS covered,
    CASE WHEN a.unit IS NULL OR b.score > a.score OR b.score = a.score AND b.name < a.name THEN {{'s': -b.score, 'name': b.name}} ELSE {{'s': -a.score, 'name': a.name}} END AS b
    FROM h LEFT JOIN bl a ON a.unit = line LEFT JOIN bl b ON b.unit = CASE WHEN next = '' THEN line ELSE line || ' ' || next END WHERE a.unit IS NOT NULL OR b.unit IS NOT NULL),
parts AS (SELECT doc_id, dir, min(b) AS b, 2 * sum(covered) >= any_value(n) OR any_value(named) AS is_file FROM hits GROUP BY doc_id, dir UNION ALL SELECT doc_id, dir, {{'s': -score, 'name': name}}, true FROM f JOIN bl ON bl.unit = f.t WHERE named),
own AS (SELECT doc_id, min(b) AS b FROM parts GROUP BY doc_id),
sp AS (SELECT dir AS up, min(b) AS b FROM parts WHERE is_file GROUP BY dir),
an AS (SELECT dir, k, array_to_string(string_split(dir, '/')[1:k], '/') AS up FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS k FROM (SELECT DISTINCT dir FROM f))),
near AS (SELECT dir, max({{'k': k, 'up': sp.up, 'b': b}}) AS x FROM an JOIN sp ON an.up = sp.up GROUP BY dir)
SELECT f.doc_id, f.dir || '/' || CASE WHEN f.named THEN 'LICENSE-' ELSE '' END || f.doc_id || '.txt' AS path, coalesce(own.b.name, CASE WHEN own.doc_id IS NULL THEN near.x.b.name END) AS license,
    CASE WHEN own.doc_id IS NOT NULL THEN -own.b.s ELSE -near.x.b.s END AS score, CASE WHEN own.doc_id IS NOT NULL THEN 'own' WHEN near.dir IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
    CASE WHEN own.doc_id IS NULL THEN near.x.up END AS from_dir
FROM f LEFT JOIN own ON own.doc_id = f.doc_id LEFT JOIN near ON near.dir = f.dir"""
