"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory, by DataFrame functions only.

Statements are the sentences and lines of a text that name a licence, and the whole text. Distinct statements
become sparse vectors of words (term frequency by smoothed inverse frequency among all
distinct statements and templates) and meet the templates by a join on words. A file's own licence is
its best statement's template, if their cosine reaches ``least``. A licence file gives its licence to its
directory; a file without one of its own takes that of the nearest directory above it that
has one, by a join of every directory's ancestors with the licensed directories.

Templates are a fixed table of some thousand words, so that broadcasting them is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import materialise

# What licences are told by, each as its authors word it: sentences of headers, and whole texts without titles and names.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
    ("GPL-2.0", "This program is free software under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    ),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD license."),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    ),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/."),
    ("Artistic-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, Creative Commons Attribution."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0, Creative Commons Attribution ShareAlike."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
    ("ISC", "Permission to use, copy, modify, and distribute this software under the ISC license."),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    ),
    (
        "Zlib",
        """This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("WTFPL", "This program is free software under the Do What The Fuck You Want To Public License."),
]
#: Texts and statements without any of these words are near no template: each template holds one that it couldn't do without.
NAMES = r"(?i)licen[cs]e|permission (?:is|to use)|redistribution|redistribute|public domain|copyright notice|warrant(?:y|ies)|may not be removed|provided .?as.is"
CUT = r"\n|[!?;]\s|\.\s"
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files: path is source/language/name; a document is a LICENSE file if half of its words, whatever their number, stand in statements that name a licence."""
    words = lambda text: F.size(F.split(text, r"[\x20\x09-\x0D]+"))
    about = F.aggregate(F.filter(F.split("text", CUT, -1), lambda x: x.rlike(NAMES)), F.lit(0), lambda n, x: n + words(x))
    mostly = F.when(F.col("text").rlike(NAMES), 2 * about >= words(F.col("text"))).otherwise(F.lit(False))
    name = F.concat(F.when(mostly, F.lit("LICENSE-")).otherwise(F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), name).alias("path"), "text")


def statements() -> Column:
    """A text's sentences and lines, and the whole of it."""
    return F.concat(F.split("text", CUT, -1), F.array("text"))


def own(files: DataFrame, least: float) -> DataFrame:
    """(statement hash, license, score) of every distinct statement that is near a template."""
    said = files.where(F.col("text").rlike(NAMES)).select(F.explode(statements()).alias("said")).where(F.col("said").rlike(NAMES))
    said = said.select(F.xxhash64("said").alias("s"), "said").dropDuplicates(["s"])
    made = files.sparkSession.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "s long, license string, said string")
    terms = lambda df, *columns: df.select("s", *columns, F.explode(F.regexp_extract_all(F.lower("said"), F.lit(WORD), F.lit(0))).alias("term")).groupBy("s", *columns, "term").agg(F.count("*").alias("tf"))
    mine, theirs = materialise(terms(said), "terms"), terms(made, "license")
    n = mine.select("s").distinct().count() + len(TEMPLATES)
    idf = mine.select("term").unionAll(theirs.select("term")).groupBy("term").agg((F.log(F.lit(float(n + 1)) / (F.count("*") + 1)) + 1).alias("idf"))
    weigh = lambda df: df.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    mine, theirs = materialise(weigh(mine), "weights"), weigh(theirs)
    norm = lambda df: df.groupBy("s").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    t = theirs.join(norm(theirs), "s").select(F.col("s").alias("t"), "license", "term", F.col("w").alias("tw"), F.col("norm").alias("tn"))
    near = mine.join(F.broadcast(t), "term").groupBy("s", "t", "license", "tn").agg(F.sum(F.col("w") * F.col("tw")).alias("dot")).join(norm(mine), "s")
    near = near.select("s", "license", F.round(F.col("dot") / (F.col("norm") * F.col("tn")), 6).alias("score")).where(F.col("score") >= least)
    return near.groupBy("s").agg(F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("best")).select("s", "best.license", (-F.col("best.less")).alias("score"))


def scan(files: DataFrame, least: float = 0.5, names: str = r"(?i)^(?:licen[cs]e|copying|notice)") -> DataFrame:
    """The rows of ``files`` (path, text; all columns but text stay, others of the added names are replaced) with own_license, own_score, license and inherited_from.

    Licence files are those whose base names match ``names``; of several in a directory the
    highest score, then the first name counts. Null texts have no licence of their own; a null path inherits
    none; repeated rows are judged alike. An empty table gives no rows.
    """
    near = materialise(own(files, least), "statements")
    added = ("own_license", "own_score", "license", "inherited_from")
    kept = [c for c in files.columns if c != "text" and c.lower() not in added]
    th = F.xxhash64("text")
    stated = files.where(F.col("text").rlike(NAMES)).select(th.alias("_h"), "text").dropDuplicates(["_h"]).select("_h", F.explode(statements()).alias("said")).select("_h", F.xxhash64("said").alias("s"))
    best = stated.join(near, "s").groupBy("_h").agg(F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("best"))
    best = materialise(best.select("_h", F.col("best.license").alias("own_license"), (-F.col("best.less")).alias("own_score")), "own")
    split = F.regexp_extract("path", r"^(?:(.*)/)?([^/]*)$", 1)
    judged = files.select(F.struct(*kept).alias("row"), th.alias("_th"), split.alias("_dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("_name")).join(best, F.col("_th") == F.col("_h"), "left").drop("_th", "_h")
    judged = materialise(judged, "files")
    given = judged.where(F.col("own_license").isNotNull() & F.col("_name").rlike(names)).groupBy("_dir").agg(F.min(F.struct((-F.col("own_score")).alias("less"), "own_license")).alias("g")).select(F.col("_dir").alias("from_dir"), F.col("g.own_license").alias("given"))
    parts = F.split("_dir", "/")
    above = judged.where("_dir is not null").select("_dir").distinct().select("_dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts"))
    above = above.select("_dir", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("from_dir"))
    taken = above.join(given, "from_dir").groupBy("_dir").agg(F.max(F.struct("depth", "from_dir", "given")).alias("x")).select(F.col("_dir").alias("_of"), "x.from_dir", "x.given")
    taken = materialise(taken, "given")
    whole = judged.join(taken, F.col("_dir") == F.col("_of"), "left")
    return whole.select(*[F.col("row").getField(c).alias(c) for c in kept], "own_license", "own_score", F.coalesce("own_license", "given").alias("license"), F.when(F.col("own_license").isNull(), F.col("from_dir")).alias("inherited_from"))


def _sql() -> str:
    made = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(TEMPLATES))
    cut = f"string_split_regex(text, '{CUT.replace(chr(92) + 's', '[ ' + chr(92) + 'x09-' + chr(92) + 'x0D]')}')"
    words = r"len(string_split_regex({}, '[ \x09-\x0D]+'))"
    return rf"""
WITH f AS (SELECT doc_id, coalesce(source, '') || '/' || coalesce(lang, '') AS dir,
    CASE WHEN coalesce(regexp_matches(text, '{NAMES}'), false) AND 2 * coalesce(list_sum([{words.format("x")} FOR x IN {cut} IF regexp_matches(x, '{NAMES}')]), 0) >= {words.format("text")} THEN 'LICENSE-' ELSE '' END || doc_id::VARCHAR AS name, text FROM documents),
st AS (SELECT doc_id, unnest(list_append({cut}, text)) AS said FROM f WHERE regexp_matches(text, '{NAMES}')),
sn AS (SELECT * FROM st WHERE regexp_matches(said, '{NAMES}')),
ds AS (SELECT DISTINCT said FROM sn),
tp AS (SELECT * FROM (VALUES {made}) AS v(t, license, said)),
ms AS (SELECT said, term, count(*) AS tf FROM (SELECT said, unnest(regexp_extract_all(lower(said), '{WORD}')) AS term FROM ds) GROUP BY ALL),
ts AS (SELECT t, license, term, count(*) AS tf FROM (SELECT t, license, unnest(regexp_extract_all(lower(said), '{WORD}')) AS term FROM tp) GROUP BY ALL),
n AS (SELECT (SELECT count(*) FROM ds) + {len(TEMPLATES)} AS n),
idf AS (SELECT term, ln((SELECT n + 1 FROM n)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM (SELECT term FROM ms UNION ALL SELECT term FROM ts) GROUP BY term),
mw AS (SELECT said, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY said)) AS norm FROM ms JOIN idf USING (term)),
tw AS (SELECT t, license, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY t)) AS norm FROM ts JOIN idf USING (term)),
c AS (SELECT mw.said, license, round(sum(mw.w * tw.w) / (any_value(mw.norm) * any_value(tw.norm)), 6) AS score FROM mw JOIN tw USING (term) GROUP BY mw.said, t, license HAVING score >= 0.5),
o AS (SELECT doc_id, license AS own_license, score AS own_score FROM sn JOIN c USING (said) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
j AS (SELECT f.doc_id, dir, name, own_license, own_score FROM f LEFT JOIN o USING (doc_id)),
g AS (SELECT dir, own_license AS given FROM j WHERE own_license IS NOT NULL AND name LIKE 'LICENSE-%' QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, own_license) = 1)
SELECT doc_id, j.dir || '/' || name AS path, own_license, own_score, coalesce(own_license, a.given, b.given) AS license,
    CASE WHEN own_license IS NULL THEN CASE WHEN a.given IS NOT NULL THEN j.dir WHEN b.given IS NOT NULL THEN b.dir END END AS inherited_from
FROM j LEFT JOIN g a ON a.dir = j.dir LEFT JOIN g b ON b.dir = split_part(j.dir, '/', 1)
"""


SQL = _sql()
