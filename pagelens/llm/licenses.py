"""Operator 4 [native]: licence scans by sparse TF-IDF cosine, and inheritance along directories.

A file is cut into units: its lines and sentences, its paragraphs (parted by
lines without letters or digits, so comment signs do no harm), and its whole
text.  Units and templates (one-line notices, SPDX tags, standard headers,
heads and bodies of licence texts) are sparse TF-IDF vectors over the
templates' terms, plus one dimension for each other term.  Document
frequencies are counted over all files.  A file's own licence is its best
template with a cosine of ``threshold`` or more.

Units are compared only if they hold an anchor: a template's rarest terms, as
many as it takes for the others to weigh less than ``threshold`` together.
A unit without an anchor cannot reach it, so the filter loses nothing.  From
there on terms are rows: joined with the templates' weights, added up by unit.

A licence file (by name, or because its whole text is one) covers its
directory: a file without an own licence inherits that of its nearest ancestor
directory that has one.  Ancestors are joined per distinct directory, so a
directory with very many files costs no more than one row before the last join.

Everything is DataFrame expressions.  The only values that reach the driver
are the document frequencies of the templates' terms (a few hundred rows).

Null and empty texts have no own licence and may inherit; a null path has no
directory.  Ties go to the longer template, then to the licence first in the
alphabet.  Repeated rows get equal results.  An empty table gives no rows.
Columns named license, score, via or license_dir are replaced, a text column
is dropped, all others pass unchanged whatever their names.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Notices, headers, heads and bodies of common licences.
_AS_IS = "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    f'THE SOFTWARE IS PROVIDED "AS IS", {_AS_IS} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
)
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
)
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


def _gnu(name: str, short: str, version: str, released: str, what: str = "This program", sign: str = ":") -> tuple[str, ...]:
    """The one-line notice, the usual header and the head of the text of a GNU licence."""
    year = released[-4:]
    return (
        f"This work is licensed under the GNU {name}, version {short}.",
        f"{what} is free software{sign} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"GNU {name.upper()} Version {version}, {released} Copyright (C) {year} Free Software Foundation, Inc. {_VERBATIM}",
        f"GNU {name.upper()} Version {version}, {released}",
    )


def _cc(kind: str, name: str) -> tuple[str, ...]:
    full = f"Creative Commons {name} 4.0 International"
    return (
        f"Licensed under CC {kind} 4.0.",
        f"This work is licensed under a {full} License.",
        f"By exercising the Licensed Rights, You accept and agree to be bound by the terms and conditions of this {full} Public License.",
        f"{full} Public License",
    )


TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": _gnu("Affero General Public License", "3", "3", "19 November 2007"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        _APACHE[0],
        " ".join(_APACHE),
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    "BSD-2-Clause": (" ".join((*_BSD, _BSD_AS_IS)), "Released under the BSD 2-Clause License."),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.", " ".join((*_BSD, _BSD_NAMES, _BSD_AS_IS)), _BSD_NAMES),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", "Boost Software License - Version 1.0 - August 17th, 2003"),
    "CC-BY-4.0": _cc("BY", "Attribution"),
    "CC-BY-NC-4.0": _cc("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-SA-4.0": _cc("BY-SA", "Attribution-ShareAlike"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Creative Commons Legal Code CC0 1.0 Universal"),
    "GPL-2.0": _gnu("General Public License", "2", "2", "June 1991", sign=";"),
    "GPL-3.0": _gnu("General Public License", "3", "3", "29 June 2007"),
    "ISC": ("Released under the ISC License.", _ISC[0], " ".join(_ISC)),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", "2.1", "February 1999", "This library", ";"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3", "3", "29 June 2007", "This library"),
    "MIT": ("Released under the MIT License.", _MIT[0], " ".join(_MIT)),
    "MPL-2.0": (
        "This work is subject to the terms of the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain under the Unlicense.", _UNLICENSE[0], " ".join(_UNLICENSE)),
    "Zlib": (" ".join(_ZLIB), _ZLIB[1], "Released under the zlib License."),
}
#: Names of licence files.
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|unlicense|notice)([._-].*)?$"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
SENTENCE_END = r"([.!?])[ \t\n\r\f]+"
PARAGRAPH_END = r"\n[^\p{L}\p{N}\n]*\n"


def parts(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> list[tuple[str, str]]:
    """(licence, text) of every template; each licence also has SPDX tags."""
    out = [(name, text) for name, texts in templates.items() for text in texts]
    for name in templates:
        kinds = ("", "-only", "-or-later") if "GPL" in name else ("",)
        out += [(name, f"SPDX-License-Identifier: {name}{kind}") for kind in kinds]
    return out


def term_counts(text: str) -> Counter:
    """The terms of a template, as ``terms`` finds those of a unit."""
    return Counter(re.findall(TERM, text.lower()))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


class Weights:
    """Template vectors of unit length, and the inverse document frequencies they come from."""

    def __init__(self, files: DataFrame, threshold: float, templates: dict[str, tuple[str, ...]]):
        self.parts = parts(templates)
        counts = [term_counts(text) for _, text in self.parts]
        vocabulary = sorted({t for c in counts for t in c})
        found = F.array_intersect(F.array_distinct(terms(F.col("text"))), F.array(*map(F.lit, vocabulary)))
        counted = files.select(F.explode(F.array_union(F.array(F.lit("")), F.coalesce(found, F.array().cast("array<string>")))).alias("term"))
        df = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.count("*").alias("n")).collect()}  # one row per term of the templates
        n = df.get("", 0) + len(counts)
        idf = lambda k: math.log((1 + n) / (1 + k)) + 1
        self.idf = {t: idf(df.get(t, 0) + sum(t in c for c in counts)) for t in vocabulary}
        self.other = idf(0)
        self.vectors, anchors = [], set()
        for c in counts:
            w = {t: k * self.idf[t] for t, k in c.items()}
            size = math.sqrt(sum(x * x for x in w.values()))
            unit = {t: x / size for t, x in w.items()}
            self.vectors.append(unit)
            # The terms that most files hold are left out first, as long as they weigh less than the threshold together.
            rest = 0.0
            for t, x in sorted(unit.items(), key=lambda e: (self.idf[e[0]], e[1], e[0])):
                rest += x * x
                if rest >= (threshold - 1e-6) ** 2:
                    anchors.add(t)
        self.anchors = sorted(anchors)

    def table(self, spark) -> DataFrame:
        """(term, weight, vector): the templates that have the term, by number, and its place in their unit vectors."""
        rows = [{"term": t, "weight": w, "vector": [{"part": k, "w": v[t]} for k, v in enumerate(self.vectors) if t in v]} for t, w in self.idf.items()]
        schema = "array<struct<term:string,weight:double,vector:array<struct<part:int,w:double>>>>"
        return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))

    def names(self, spark) -> DataFrame:
        """(part, license, size) of the templates."""
        rows = [{"part": k, "license": name, "size": sum(term_counts(text).values())} for k, (name, text) in enumerate(self.parts)]
        return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<part:int,license:string,size:int>>")))


def units(text: Column, anchors: list[str]) -> Column:
    """array<struct(whole, text)>: the units of a text that hold an anchor, none if the text has none."""
    holds = lambda x: F.arrays_overlap(terms(x), F.array(*map(F.lit, anchors)))
    lines = F.split(F.regexp_replace(text, SENTENCE_END, "$1\n"), "\n")
    inner = F.filter(F.array_distinct(F.concat(lines, F.split(text, PARAGRAPH_END))), lambda x: holds(x) & (x != text))
    both = F.concat(F.array(F.struct(F.lit(True).alias("whole"), text.alias("text"))), F.transform(inner, lambda x: F.struct(F.lit(False).alias("whole"), x.alias("text"))))
    return F.when(holds(text), both)


def own_licenses(stored: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """(key, license, score, whole) of the files that reach the threshold; ``stored``: key, units."""
    spark = stored.sparkSession
    each = stored.filter("units IS NOT NULL").select("key", F.posexplode("units").alias("unit", "u"))
    counted = each.select("key", "unit", F.col("u.whole").alias("whole"), F.explode(terms(F.col("u.text"))).alias("term")).groupBy("key", "unit", "whole", "term").agg(F.count("*").cast("double").alias("n"))
    # The templates' terms are a proven bound for what is broadcast.
    weighted = counted.join(F.broadcast(weights.table(spark)), "term", "left").withColumn("x", F.col("n") * F.coalesce("weight", F.lit(weights.other)))
    norms = weighted.groupBy("key", "unit", "whole").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighted.select("key", "unit", "x", F.explode("vector").alias("v")).groupBy("key", "unit", F.col("v.part").alias("part")).agg(F.sum(F.col("x") * F.col("v.w")).alias("dot"))
    scored = dots.join(norms, ["key", "unit"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= threshold)
    named = scored.join(F.broadcast(weights.names(spark)), "part")
    best = F.min(F.struct((-F.col("score")).alias("s"), (-F.col("size")).alias("size"), F.col("license").alias("license"))).alias("best")
    return named.groupBy("key").agg(best, F.max("whole").alias("whole")).select("key", F.col("best.license").alias("license"), (-F.col("best.s")).alias("score"), "whole")


def directory(path: Column) -> Column:
    """The directory of a path without empty steps; the root is ''."""
    steps = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.array_join(F.slice(steps, F.lit(1), F.greatest(F.size(steps) - 1, F.lit(0))), "/")


def ancestors(where: Column) -> Column:
    """The directory and all above it, with their depths."""
    steps = F.filter(F.split(where, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, F.lit(1), k), "/").alias("ancestor")))


def license_scan(files: DataFrame, threshold: float = 0.6, templates: dict[str, tuple[str, ...]] = TEMPLATES, most_broadcast: int = 100_000) -> DataFrame:
    """Adds to ``files`` (path, text and any other columns; the text is dropped):

    license, score, via ('own', 'inherited' or 'none') and license_dir (of an
    inherited licence).  ``templates``: texts of each licence.  Covered
    directories are broadcast if there are at most ``most_broadcast``.
    """
    weights = Weights(files.select("text"), threshold, templates)
    keep = [c for c in files.columns if c not in ("text", "license", "score", "via", "license_dir")]
    # Stored once without the texts but for candidate units: the keys stay what they are, and the steps below read it.
    stored = materialize(files.select(F.monotonically_increasing_id().alias("key"), F.struct(*keep).alias("row"), F.col("path"), units(F.col("text"), weights.anchors).alias("units")), "licence-units")
    own = materialize(own_licenses(stored.select("key", "units"), weights, threshold), "licences")
    base = F.element_at(F.split("path", "/"), -1)
    owned = stored.select("key", "row", directory(F.col("path")).alias("dir"), base.rlike(LICENSE_FILE).alias("named")).join(own, "key", "left")
    covered = owned.filter("license IS NOT NULL AND dir IS NOT NULL AND (named OR whole)").groupBy(F.col("dir").alias("ancestor")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license").alias("license"))).alias("best")).select("ancestor", F.col("best.license").alias("dir_license"))
    directories = owned.filter("license IS NULL AND dir IS NOT NULL").select("dir").distinct()
    inherited = directories.select("dir", F.explode(ancestors(F.col("dir"))).alias("a")).select("dir", "a.*").join(covered, "ancestor")
    inherited = inherited.groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "dir_license")).alias("nearest")).select("dir", F.col("nearest.ancestor").alias("from_dir"), F.col("nearest.dir_license").alias("from_license"))
    inherited = materialize(inherited, "covered-directories")
    if inherited.count() <= most_broadcast:
        inherited = F.broadcast(inherited)
    out = owned.join(inherited, "dir", "left")
    has = F.col("license").isNotNull()
    return out.select(
        *[F.col("row")[c].alias(c) for c in keep],
        F.coalesce("license", "from_license").alias("license"),
        "score",
        F.when(has, "own").when(F.col("from_license").isNotNull(), "inherited").otherwise("none").alias("via"),
        F.when(~has, F.col("from_dir")).alias("license_dir"),
    )
