"""Licence scan: sparse TF-IDF cosine of lines to templates, then inheritance from the nearest directory above.

Where a text has a licence cue, its lines and blocks of lines with one (headers) and the whole of it (licence files) are compared with
licence templates: short names, standard headers, SPDX tags and whole licence texts.  Terms weigh their count times the inverse document frequency
over the templates, so words that nearly all of them hold (``the``, ``of``) make no licence of a long text; the
cosine is summed over shared terms only.  Comment signs are no terms.  Each distinct line or text is scored once, however many documents hold
it.  The best match gives a document its own licence.

A document that matches as a whole, or whose matching lines or blocks hold a good part of it, is the licence file of its directory.  A document without a licence of
its own inherits that of the licence file in the nearest directory above it: directories, not documents, are
joined to their ancestors, and documents take the result of their directory by an equi-join.

Null and empty texts have no licence of their own.  A null path has no directory and inherits nothing.  Ties
of a cosine go to the first licence by name, ties of licence files to the first path.  Rows that repeat an id share
the best line of all of them; rows without an id share that of their path, and a row without both has no licence of its own.  Empty tables give empty results.  Only the named columns are read.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: The least cosine for a licence.
MIN_COSINE = 0.6
#: The least share of a licence file's characters that lie in licence lines, or in licence blocks.
FILE_SHARE = 0.25

#: What a text, line or block must hold to be compared.
CUE = (
    r"(?i)licen[sc]e|copyright|spdx|creative commons|public domain|rights reserved|redistribution and use|permission is hereby"
    r"|permission to use|without warranty|provided .as is"
)
#: Blocks lie between blank lines; a line with only a comment sign is not blank, so a commented header is one block.
BLANK = r"\n[ \t\r]*\n"

#: Names and the words of short headers; after a slash, of the standard headers, tags and whole texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License. Redistribution and use in source and binary forms.",
    "CC-BY-4.0": "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0. Creative Commons Attribution ShareAlike 4.0 International.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "Copyright. All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Apache-2.0/header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain'
    " a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License"
    ' is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing'
    " permissions and limitations under the License.",
    "AGPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation,"
    " either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"
    " without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the"
    " GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "GPL-2.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,"
    " either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"
    " without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the"
    " GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "GPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,"
    " either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"
    " without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the"
    " GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "LGPL-2.1/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation,"
    " either version 2.1 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"
    " without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the"
    " GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "LGPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation,"
    " either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"
    " without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the"
    " GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,"
    " You can obtain one at https://mozilla.org/MPL/2.0/.",
}

#: SPDX identifiers that tags name, and the licence each stands for.
SPDX = {n: n for n in ("0BSD", "Artistic-1.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0",
    "ISC", "MIT", "MPL-1.1", "MPL-2.0", "NCSA", "OFL-1.1", "Unlicense", "Zlib", "Apache-2.0")} | {
    f"{n}{end}": n for n in ("AGPL-3.0", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0") for end in ("", "-only", "-or-later")
}
TEMPLATES |= {f"{n}/spdx/{tag}": f"SPDX-License-Identifier: {tag}" for tag, n in SPDX.items()}
#: Whole licence texts, one file each.
TEMPLATES |= {f.name.removesuffix(".txt") + "/file": f.read_text("utf-8") for f in sorted(resources.files(__package__).joinpath("licenses").iterdir(), key=lambda f: f.name)}

_WORD = "[a-z0-9]+"


def weights(templates: dict[str, str] = TEMPLATES) -> tuple[dict[str, float], float, dict[str, dict[str, float]]]:
    """Inverse document frequencies, that of an unknown term, and each template's terms scaled to length 1."""
    counts = {n: Counter(re.findall(_WORD, t.lower())) for n, t in templates.items()}
    df = Counter(w for c in counts.values() for w in c)
    idf = {w: math.log((2 + len(templates)) / (1 + n)) for w, n in df.items()}
    scaled = {}
    for name, c in counts.items():
        size = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        scaled[name] = {w: n * idf[w] / size for w, n in c.items()}
    return idf, math.log(2 + len(templates)), scaled


def term_table(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(term, idf, one column w<i> for each template, null where it lacks the term), from one constant of the plan."""
    idf, _, scaled = weights(templates)
    names = sorted(templates)
    rows = [{"term": t, "idf": i} | {f"w{k}": scaled[n][t] for k, n in enumerate(names) if t in scaled[n]} for t, i in sorted(idf.items())]
    row = "term: string, idf: double, " + ", ".join(f"w{k}: double" for k in range(len(names)))
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{row}>>")))


def scored(units: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(key, license, score) of each distinct unit of text (key, unit), where a template is similar enough."""
    names, (_, unknown, _) = sorted(templates), weights(templates)
    words = F.regexp_extract_all(F.lower("unit"), F.lit(_WORD), F.lit(0))
    terms = units.dropDuplicates(["key"]).select("key", F.explode(words).alias("term"))
    counted = terms.groupBy("key", "term").agg(F.count("*").alias("n"))
    joined = counted.join(F.broadcast(term_table(units.sparkSession, templates)), "term", "left")
    weight = F.col("n") * F.coalesce("idf", F.lit(unknown))
    sums = joined.groupBy("key").agg(
        F.sqrt(F.sum(weight * weight)).alias("size"), *(F.sum(weight * F.coalesce(f"w{k}", F.lit(0.0))).alias(f"d{k}") for k in range(len(names)))
    )
    # Greatest first, then the earlier name.
    best = F.greatest(*(F.struct(F.round(F.col(f"d{k}") / F.col("size"), 6).alias("score"), F.lit(-k).alias("place")) for k in range(len(names))))
    named = sums.select("key", best.alias("best")).where(F.col("best.score") >= MIN_COSINE)
    licenses = F.array(*(F.lit(n.split("/")[0]) for n in names))
    return named.select("key", F.get(licenses, -F.col("best.place")).alias("license"), F.col("best.score").alias("score"))


def directory(path: Column) -> Column:
    """What comes before the last slash; null for a null path, empty at the top."""
    return F.when(path.isNotNull(), F.regexp_extract(path, r"^(.*)/[^/]*$", 1))


def ancestors(folder: Column) -> Column:
    """A directory and those above it, nearest first."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan_licenses(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(id, path, own_license, own_score, license, inherited_from) of every row."""
    own = docs.select(F.col(id_col).alias("_id"), path.alias("path"), F.col(text_col).alias("_text"))
    own = own.withColumn("_key", F.coalesce(F.concat(F.lit("i"), F.col("_id").cast("string")), F.concat(F.lit("p"), "path")))
    lines = F.transform(F.filter(F.split("_text", "\n"), lambda x: x.rlike(CUE)), lambda x: F.struct(x.alias("unit"), F.lit("line").alias("kind")))
    blocks = F.filter(F.split("_text", BLANK), lambda x: F.contains(F.trim(x, F.lit("\n")), F.lit("\n")) & x.rlike(CUE))
    blocks = F.transform(blocks, lambda x: F.struct(x.alias("unit"), F.lit("block").alias("kind")))
    units = F.concat(lines, blocks, F.array(F.struct(F.col("_text").alias("unit"), F.lit("whole").alias("kind"))))
    with_cue = own.where(F.col("_text").rlike(CUE)).select("_key", "path", F.char_length("_text").alias("_n"), F.explode(units).alias("u"))
    with_cue = with_cue.select("_key", "path", "_n", "u.*", F.sha2(F.col("u.unit").cast("binary"), 256).alias("key"))
    with_cue = stored(with_cue, "license_units", True)  # few of all texts; so these are scanned once
    # Written before it is joined: the plan can then split the rows of a line that very many documents have.
    scores = stored(scored(with_cue.select("key", "unit"), templates), "license_scores", True)
    hits = with_cue.select("_key", "path", "_n", "kind", "key", F.char_length("unit").alias("length")).join(scores, "key")
    order = F.struct(-F.col("score"), F.col("license"))
    best = hits.groupBy("_key").agg(F.max("score").alias("own_score"), F.min_by("license", order).alias("own_license"))
    # Licence files: by directory, the one of the greatest score, then of the first path.
    files = hits.groupBy("_key", "path", "_n").agg(
        F.greatest(*(F.sum(F.when(F.col("kind") == k, F.col("length"))) for k in ("line", "block", "whole"))).alias("held"), F.max("score").alias("score"), F.min_by("license", order).alias("license")
    )
    files = files.where(F.col("held") >= FILE_SHARE * F.col("_n")).withColumn("folder", directory(F.col("path"))).where("folder IS NOT NULL")
    files = files.groupBy("folder").agg(F.min_by(F.struct("license", "path"), F.struct(-F.col("score"), F.col("path"))).alias("f"))
    rows = own.select("_id", "_key", "path").withColumn("folder", directory(F.col("path")))
    above = rows.select("folder").where("folder IS NOT NULL").distinct().select("folder", F.posexplode(ancestors(F.col("folder"))).alias("up", "ancestor"))
    found = above.join(files.withColumnRenamed("folder", "ancestor"), "ancestor").groupBy("folder").agg(F.min_by("f", "up").alias("f"))
    out = rows.join(best, "_key", "left").join(found, "folder", "left")
    return out.select(
        F.col("_id").alias(id_col),
        "path",
        "own_license",
        "own_score",
        F.coalesce("own_license", "f.license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("f.path")).alias("inherited_from"),
    )
