"""Operator 7, license scans: only DataFrame functions, no Python on the executors.

A file's lines are compared with licence templates by the cosine of sparse TF-IDF
vectors, a word's frequency counting as 1 + ln. Words are runs of a-z and 0-9 in lower case. Document frequencies of all
template words are counted over all files; a word that no template has weighs as
one that no file has, so that long prose lines score low.

Only lines that can reach the threshold are scored: per template, the heaviest words
are taken until what is left could not reach it, and a line needs one of those words
(an exact prefix filter). Templates may also be wrapped over lines or stand inside a longer
line: around each of its heavy words, wherever in the file, a template is compared with the
window of as many words as it has. A file's own licence is that of its best line or window.

A file named LICENSE, LICENCE, COPYING or NOTICE, or a short file that holds a licence
line, is a licence file: it covers its directory. A file without a licence of its own
inherits that of the nearest ancestor directory with one, by joins on paths. Files are
salted by path there, since one directory may hold a third of them.

Defined cases: null text has no lines; very long texts are scanned whole; a null path has no ancestors; several licence
files in a directory: the best score, then the smallest licence, then the smallest path;
no files, no rows; repeated rows each get a row; columns named like the added ones are
replaced.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked, word_count

TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    # whole notices and licences: compared with windows of as many words
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy '
        "of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
        "language governing permissions and limitations under the License.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to '
        "deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
        "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT "
        "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]
THRESHOLD = 0.75
SHORT_FILE = 40  # words
SALT = 16


def terms(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for w in re.findall(r"[a-z0-9]+", text.lower()):
        out[w] = out.get(w, 0) + 1
    return out


def line_words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), 0)


def document_frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of files, and of those that hold each word of the (fixed) vocabulary."""
    # whole words only: a cheap pattern first leaves few candidates to split
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w.isin(vocabulary)))
    rows = files.select(F.explode(words).alias("w")).groupBy("w").count().collect()
    return files.count(), {r["w"]: r["count"] for r in rows}


def heavy(weights: dict[str, float], threshold: float) -> set[str]:
    """Words of which a line needs at least one to reach the threshold."""
    left = math.sqrt(sum(x * x for x in weights.values()))
    norm, out, rest = left, set(), dict(weights)
    for w in sorted(weights, key=lambda w: (-weights[w], w)):
        if math.sqrt(max(0.0, sum(x * x for x in rest.values()))) < (threshold - 1e-3) * norm:
            break
        out.add(w)
        del rest[w]
    return out


def own_license(files: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """files with own_license (null: none) and score (4 decimals, 0: none)."""
    vectors = [(name, terms(text)) for name, text in templates]
    vocabulary = sorted({w for _, v in vectors for w in v})
    n, df = document_frequencies(files, vocabulary)
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    unknown = math.log(1 + n) + 1
    weights = [{w: (1 + math.log(k)) * idf[w] for w, k in v.items()} for _, v in vectors]
    heavies = [heavy(w, threshold) for w in weights]
    trigger = sorted(set().union(*heavies))
    # words by their first letter, so that most places of a text are done with after one comparison
    by_letter = {c: "|".join(w[1:] for w in trigger if w[0] == c) for c in sorted({w[0] for w in trigger})}
    pattern = f"(?<![a-z0-9])(?:{'|'.join(f'{c}(?:{rest})' for c, rest in by_letter.items())})(?![a-z0-9])"
    idf_map = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, idf[w])])

    def weight_map(v: dict[str, float]) -> Column:
        return F.create_map(*[F.lit(x) for w, k in v.items() for x in (w, k)])

    known = F.array(*[
        F.struct(F.lit(-i).alias("rank"), F.lit(math.sqrt(sum(x * x for x in v.values()))).alias("norm"), weight_map(v).alias("w"))
        for i, v in enumerate(weights)
    ])

    def scored(words: Column, against: Column = known) -> Column:
        tf = F.transform(F.array_distinct(words), lambda w: F.struct(
            w.alias("w"),
            ((F.lit(1.0) + F.log(F.size(F.filter(words, lambda x: x == w)))) * F.coalesce(F.try_element_at(idf_map, w), F.lit(unknown))).alias("x"),
        ))
        norm = F.sqrt(F.aggregate(tf, F.lit(0.0), lambda a, t: a + t["x"] * t["x"]))
        return F.array_max(F.transform(against, lambda k: F.struct(
            F.round(F.aggregate(tf, F.lit(0.0), lambda a, t: a + t["x"] * F.coalesce(F.try_element_at(k["w"], t["w"]), F.lit(0.0))) / (norm * k["norm"]), 4).alias("score"),
            k["rank"].alias("rank"),
        )))

    def anchors(word: str) -> list[Column]:
        """Where a heavy word stands in its templates."""
        found = [(i, j, len(ws)) for i, ws in enumerate(ordered) if word in heavies[i] for j, w in enumerate(ws) if w == word]
        return [F.struct(F.lit(i + 1).alias("at"), F.lit(j).alias("offset"), F.lit(size).alias("size")) for i, j, size in found]

    ordered = [re.findall(r"[a-z0-9]+", text.lower()) for _, text in templates]
    anchor_map = F.create_map(*[x for w in trigger for x in (F.lit(w), F.array(*anchors(w)))])
    places = F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(trigger))
    windows = F.array_distinct(F.flatten(F.transform(places, lambda x: F.transform(
        F.try_element_at(anchor_map, x["w"]),
        lambda a: F.struct(a["at"].alias("at"), (x["i"] - a["offset"]).alias("start"), a["size"].alias("size")),
    ))))
    cut = F.transform(windows, lambda x: F.struct(
        x["at"].alias("at"),
        F.slice("_words", F.greatest(x["start"], F.lit(0)) + 1, x["size"] + F.least(x["start"], F.lit(0))).alias("words"),
    ))
    lines = F.filter(F.split("text", "\n"), lambda x: F.lower(x).rlike(pattern))
    best = F.array_max(F.concat(
        F.transform(F.transform(lines, line_words), lambda x: scored(x)),
        F.transform(cut, lambda x: scored(x["words"], F.array(F.element_at(known, x["at"])))),
    ))
    names = F.array(*[F.lit(name) for name, _ in templates])
    held = files.withColumn("_words", F.when(F.col("text").isNotNull() & F.lower("text").rlike(pattern), line_words(F.col("text"))))
    found = held.withColumn("_best", F.when(F.col("_words").isNotNull(), best))
    sure = F.coalesce(F.col("_best.score") >= threshold, F.lit(False))
    return found.withColumns({
        "own_license": F.when(sure, F.element_at(names, 1 - F.col("_best.rank"))),
        "score": F.when(sure, F.col("_best.score")).otherwise(0.0),
    }).drop("_best", "_words")


def ancestors(directory: Column) -> Column:
    """'a/b' gives ['a/b', 'a', '']: nearest first."""
    parts = F.split(directory, "/")
    own = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.concat(own, F.array(F.lit(""))))


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds license and licensed_by ('own', a directory, or null)."""
    named = F.regexp_extract("path", "[^/]*$", 0).rlike("(?i)^(licen[cs]e|copying|notice)([.-].*)?$")
    files = scanned.withColumns({
        "_dir": F.regexp_replace(F.regexp_extract("path", "^(.*)/[^/]*$", 1), "^/+", ""),
        "license_file": F.coalesce(F.col("own_license").isNotNull() & (named | (word_count(F.col("text")) <= SHORT_FILE)), F.lit(False)),
    })
    covering = (
        files.filter(F.col("license_file") & F.col("path").isNotNull())
        .groupBy(F.col("_dir").alias("_from"))
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "own_license", "path")).alias("_c"))
        .select("_from", F.col("_c.own_license").alias("_license"))
    )
    dirs = files.filter(F.col("path").isNotNull()).select("_dir").distinct()
    nearest = (
        dirs.select("_dir", F.posexplode(ancestors(F.col("_dir"))).alias("_depth", "_from"))
        .join(covering, "_from")
        .groupBy("_dir")
        .agg(F.min(F.struct("_depth", "_from", "_license")).alias("_near"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    )
    joined = files.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(SALT)).cast("int")).join(nearest, ["_dir", "_salt"], "left")
    return joined.withColumns({
        "license": F.coalesce("own_license", F.col("_near._license")),
        "licensed_by": F.when(F.col("own_license").isNotNull(), F.lit("own")).otherwise(F.concat(F.lit("/"), F.col("_near._from"))),
    }).drop("_dir", "_salt", "_near")


def license_scan(files: DataFrame, threshold: float = THRESHOLD, columns: list[str] | None = None) -> DataFrame:
    """files (path, text, ...; their `columns`, all by default) with own_license, score, license_file, license, licensed_by."""
    added = ("own_license", "score", "license_file", "license", "licensed_by")
    columns = [c for c in (files.columns if columns is None else columns) if c not in added]
    out = inherit(own_license(files.select(packed(columns).alias("row"), "path", "text"), threshold))
    return out.select(*unpacked(columns), *added)


def oracle() -> str:
    """DuckDB SQL for the op7 query."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {q(name)}, {q(text)})" for i, (name, text) in enumerate(TEMPLATES))
    words = r"'[a-z0-9]+'"
    return f"""
with templates(rank, name, text) as (values {values}),
tw as (select rank, w, count(*) as k from (select rank, unnest(regexp_extract_all(lower(text), {words})) as w from templates) group by all),
vocabulary as (select distinct w from tw),
files as (select doc_id, text, coalesce(source, '') || '/' || coalesce(lang, '') || '/' || doc_id as path, coalesce(source, '') as source, coalesce(lang, '') as lang from documents),
n as (select count(*) as n from files),
df as (select w, count(*) as df from (select distinct doc_id, unnest(regexp_extract_all(lower(text), {words})) as w from files) join vocabulary using (w) group by w),
idf as (select w, ln((1 + n) / (1 + coalesce(df, 0))::double) + 1 as idf from vocabulary left join df using (w) cross join n),
tv as (select rank, w, (1 + ln(k)) * idf as x from tw join idf using (w)),
tn as (select rank, sqrt(sum(x * x)) as norm from tv group by rank),
lines as (select doc_id, row_number() over () as line, text from (select doc_id, unnest(string_split(text, chr(10))) as text from files where text is not null)),
lw as (select doc_id, line, w, count(*) as k from (select doc_id, line, unnest(regexp_extract_all(lower(text), {words})) as w from lines) group by all),
lv as (select doc_id, line, w, (1 + ln(k)) * coalesce(idf, ln(1 + n::double) + 1) as x from lw left join idf using (w) cross join n),
ln as (select line, sqrt(sum(x * x)) as norm from lv group by line),
cosine as (select doc_id, rank, round(sum(lv.x * tv.x) / (max(ln.norm) * max(tn.norm)), 4) as score from lv join tv using (w) join tn using (rank) join ln using (line) group by doc_id, line, rank),
best as (select doc_id, score, name from (select *, row_number() over (partition by doc_id order by score desc, rank) as r from cosine where score >= {THRESHOLD}) join templates using (rank) where r = 1),
own as (select f.*, name as own_license, coalesce(score, 0.0) as score,
  name is not null and len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) <= {SHORT_FILE} as license_file from files f left join best using (doc_id)),
cover as (select source, lang, own_license from (select *, row_number() over (partition by source, lang order by score desc, own_license, path) as r from own where license_file) where r = 1)
select doc_id, own.path, own.own_license, score, license_file, coalesce(own.own_license, cover.own_license) as license,
  case when own.own_license is not null then 'own' when cover.own_license is not null then '/' || own.source || '/' || own.lang end as licensed_by
from own left join cover on own.source = cover.source and own.lang = cover.lang
"""
