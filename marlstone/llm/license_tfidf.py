"""Licences by sparse TF-IDF cosine to templates, and inheritance from the nearest directory above.

1. A file's units are its whole text, its blocks (runs of lines without a blank one), its runs of comment lines,
   and its lines, so that a notice is met as it stands: alone, wrapped in a header, or as a licence's full text. A unit is
   the counts of its lower-cased terms.
2. A term's weight is ``(1 + ln tf) * idf``, ``idf = ln((1 + N) / (1 + df)) + 1`` over all files of the corpus, the templates
   among them. A term of no template counts in a unit's length with weight 1, so that a licence's name inside other
   prose scores lower than a notice.
3. A unit's cosine with each template comes from a join on shared terms, summed by (unit, template). A file's licence is
   that of its best unit with ``LEAST`` or more; ``Proprietary`` counts only where no other licence has that.
   Units that can't reach ``LEAST`` are left out by an exact bound: of each template, the terms of least weight
   whose norm together is under ``LEAST`` of the whole; a unit with none of the other terms has a lower cosine.
4. A licence file is a file with a licence that is named like one (``LICENSE``, ``COPYING``), or whose whole text has ``FILE_LEAST``
   or more with its licence, or that begins with the licence's title and has half its terms or more from templates. The licence files
   of a directory give the directory its licence (the best cosine; ties by name). Each directory, once, is joined to
   its ancestors by path, and takes the deepest that has one; files without a notice of their own
   take their directory's.

The templates are a fixed list, or the caller's, and their terms are broadcast. Terms are folded within a unit
before any shuffle; joins by directory have one row for each directory on one side. No Python runs on
executors.

Defined cases: a null text has no units; a null path is in no directory and inherits nothing; rows repeat as they are
(each gets the same answer); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, settle

LEAST, FILE_LEAST, TITLE_LEAST, SHARE = 0.5, 0.7, 0.85, 0.5
#: Decimal places of a cosine, so that the order of a sum doesn't show.
PLACES = 6
LAST = "Proprietary"


def _gnu(name: str, version: str, mark: str = ",") -> str:
    """The notice that programs and libraries under a GNU licence carry, without either word."""
    return (
        f"This is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{mark} either version {version} of the License, or (at your option) any later version. "
        f"This is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. "
        f"You should have received a copy of the {name} along with this."
    )


def _gnu_short(name: str, version: str) -> str:
    return f"under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version"


#: Notices and texts of well-known licences, as their authors word them.
_AS_IS = 'IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. '
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. ' + _AS_IS
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. '
_MIT_END = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_END = ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
_CC0 = "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"

#: Notices and full texts, and, after them, titles.
TEMPLATES: dict[str, tuple[list[str], list[str]]] = {
    "AGPL-3.0": ([_gnu("GNU Affero General Public License", "3"), _gnu_short("GNU Affero General Public License", "3"), "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0"], ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"]),
    "Apache-2.0": ([_APACHE + _APACHE_END, _APACHE, "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"], ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License, Version 2.0"]),
    "BSD-2-Clause": ([_BSD + _BSD_END, "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"], ["BSD 2-Clause License"]),
    "BSD-3-Clause": ([_BSD + _BSD_NAME + _BSD_END, _BSD_NAME, "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"], ["BSD 3-Clause License"]),
    "CC-BY-4.0": (["This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"], ["Creative Commons Attribution 4.0 International"]),
    "CC-BY-NC-4.0": (["This work is licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"], ["Creative Commons Attribution-NonCommercial 4.0 International"]),
    "CC-BY-SA-4.0": (["This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"], ["Creative Commons Attribution-ShareAlike 4.0 International"]),
    "CC0-1.0": ([_CC0, "Dedicated to the public domain under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"], ["CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal"]),
    "GPL-2.0": ([_gnu("GNU General Public License", "2", ";"), _gnu_short("GNU General Public License", "2"), "Licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0"], ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"]),
    "GPL-3.0": ([_gnu("GNU General Public License", "3"), _gnu_short("GNU General Public License", "3"), "Licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0"], ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"]),
    "ISC": ([_ISC + _ISC_END, "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"], ["ISC License"]),
    "LGPL-2.1": ([_gnu("GNU Lesser General Public License", "2.1", ";"), _gnu_short("GNU Lesser General Public License", "2.1"), "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1"], ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"]),
    "LGPL-3.0": ([_gnu("GNU Lesser General Public License", "3"), _gnu_short("GNU Lesser General Public License", "3"), "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"], ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"]),
    "MIT": ([_MIT + _MIT_END, _MIT, "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"], ["MIT License", "The MIT License (MIT)"]),
    "MPL-2.0": ([_MPL, "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"], ["Mozilla Public License Version 2.0"]),
    LAST: (["All rights reserved.", "All rights reserved. No part may be reproduced without permission.", "Copyright. All rights reserved. Proprietary and confidential."], []),
    "Unlicense": ([_UNLICENSE, "SPDX-License-Identifier: Unlicense"], ["The Unlicense"]),
}

TERM = r"[a-z0-9]+(?:[.-][0-9]+)*"
BLANK_LINE = r"\n[ \t\r]*\n"
COMMENTS = r"(?:(?:^|\n)[ \t]*(?://|/\*|\*|#|--|;|%|<!--)[^\n]*)+"
#: The name of a licence file, lower-cased.
NAMED = r"(?:^|/)(?:licen[cs]e|copying|unlicense|copyright)(?:[.-][^/]*)?$"

Templates = dict[str, tuple[list[str], list[str]]]


def template_terms(templates: Templates | None = None) -> list[tuple[str, str, bool, str, int]]:
    """(template, licence, whether a title, term, count)."""
    out = []
    for name, (texts, titles) in (templates or TEMPLATES).items():
        for k, text in enumerate([*texts, *titles]):
            terms = re.findall(TERM, text.lower())
            out += [(f"{name}/{k}", name, k >= len(texts), t, terms.count(t)) for t in sorted(set(terms))]
    return out


def needed(weights: dict[str, dict[str, float]], least: float = LEAST) -> list[str]:
    """Terms of which every unit with a cosine of ``least`` or more has one: of each template all but its lightest terms whose norm is less than that share."""
    out: set[str] = set()
    for terms in weights.values():
        total, rest = sum(w * w for w in terms.values()), 0.0
        for t, w in sorted(terms.items(), key=lambda x: (x[1], x[0])):
            rest += w * w
            if rest >= (least - 1e-5) ** 2 * total:
                out.add(t)
    return sorted(out)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def units(text: Column) -> Column:
    """The whole text, its first block, its further blocks, its runs of comments, its lines."""
    some = lambda x: F.filter(x, lambda u: u.rlike(r"\S"))
    return F.concat(F.array(text), some(F.split(text, BLANK_LINE, -1)), F.regexp_extract_all(text, F.lit(COMMENTS), F.lit(0)), some(F.split(text, "\n", -1)))


def own(files: DataFrame, templates: Templates | None = None) -> DataFrame:
    """(rid, text) -> (rid, license, cosine, like_file): the best notice of each file that has one of ``LEAST`` or more; and whether the file is like a licence file.

    Rows of one rid are equal and give one row.
    """
    spark = files.sparkSession
    listed = template_terms(templates)
    known = sorted({t for *_, t, _ in listed})
    vocabulary = F.broadcast(spark.createDataFrame([(t,) for t in known], "term string"))
    # As many rows as the templates have terms, and one with the number of files.
    counted = files.select(F.explode(F.concat(F.array_intersect(_terms(F.col("text")), F.lit(known)), F.array(F.lit("")))).alias("term"))
    df = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.count("*").alias("n")).collect()}
    n_all = df.get("", 0) + len({t for t, *_ in listed})
    idf = {}
    for *_, t, _ in listed:
        idf[t] = log((1 + n_all) / (1 + df.get(t, 0) + sum(x == t for *_, x, _ in listed))) + 1 if t not in idf else idf[t]
    weights: dict[str, dict[str, float]] = {}
    for template, _, _, t, n in listed:
        weights.setdefault(template, {})[t] = (1 + log(n)) * idf[t]
    asked = F.lit(needed(weights))
    about = {template: (license, title) for template, license, title, *_ in listed}
    rows = [(template, t, w / sum(x * x for x in ws.values()) ** 0.5, idf[t]) for template, ws in weights.items() for t, w in ws.items()]
    weighed = F.broadcast(spark.createDataFrame(rows, "template string, term string, share double, idf double"))
    rarity = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))

    some = files.where(F.arrays_overlap(_terms(F.col("text")), asked)).withColumn("row", F.monotonically_increasing_id())
    each = some.select("rid", "row", F.posexplode(units(F.col("text"))).alias("unit", "u")).select("rid", "row", "unit", _terms(F.col("u")).alias("terms")).where(F.arrays_overlap("terms", asked))
    # A row for each (unit, term) of a file's row, with the number of times; then once for equal rows. Texts aren't shuffled, nor terms of no template.
    own = each.select("rid", "row", "unit", F.size("terms").alias("n"), F.explode("terms").alias("term")).join(vocabulary, "term").groupBy("rid", "row", "unit", "n", "term").agg(F.count("*").alias("tf"))
    hits = settle(own.groupBy("rid", "unit", "n", "term").agg(F.max("tf").alias("tf")))
    weight = (1 + F.log("tf")) * F.col("idf")
    norms = hits.join(rarity, "term").groupBy("rid", "unit", "n").agg(F.sum(F.pow(weight, 2)).alias("known"), F.sum("tf").alias("n_known"))
    # No cosine is over the share of a unit's length that known terms have, so most units go before they meet templates.
    square = F.col("known") + (F.col("n") - F.col("n_known"))
    enough = settle(norms.where(F.col("known") >= (LEAST - 1e-5) ** 2 * square).select("rid", "unit", F.sqrt(square).alias("size"), (F.col("n_known") >= SHARE * F.col("n")).alias("known_text")))
    dots = hits.join(enough, ["rid", "unit"]).join(weighed, "term").groupBy("rid", "unit", "template").agg(F.sum(weight * F.col("share")).alias("dot"), F.first("size").alias("size"))
    told = F.broadcast(spark.createDataFrame([(template, *x) for template, x in about.items()], "template string, license string, title boolean"))
    scored = dots.withColumn("cosine", F.round(F.col("dot") / F.col("size"), PLACES)).where(F.col("cosine") >= LEAST).join(told, "template")
    like = ((F.col("unit") == 0) & (F.col("cosine") >= FILE_LEAST)) | (F.col("title") & (F.col("unit") == 1) & (F.col("cosine") >= TITLE_LEAST))
    by_license = scored.groupBy("rid", "license").agg(F.max("cosine").alias("cosine"), F.max((F.col("unit") == 0) & (F.col("cosine") >= FILE_LEAST)).alias("whole"), F.max(like).alias("headed"))
    best = by_license.groupBy("rid").agg(F.min(F.struct((F.col("license") == LAST).alias("last"), (-F.col("cosine")).alias("less"), "license", "whole", "headed")).alias("b"))
    shares = enough.where("unit = 0").select("rid", "known_text")
    out = best.join(shares, "rid", "left")
    return out.select("rid", F.col("b.license").alias("license"), (-F.col("b.less")).alias("cosine"), (F.col("b.whole") | (F.col("b.headed") & F.coalesce("known_text", F.lit(False)))).alias("like_file"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def scan(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", templates: Templates | None = None) -> DataFrame:
    """One row for each row of ``files``: id, path, license, cosine, license_file, inherited (from the directory), license_from.

    ``license_from`` is ``notice``, ``directory`` or null. ``templates``: for each licence its notices and texts, and its titles.
    """
    f = pick(files, id=id_col, text=text_col, path=path_col)
    # A row's number: the digest of its content, each part with its length; equal rows share it.
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    rid = F.sha2(F.concat(*[part(F.col(c).cast("string")) for c in ("id", "path", "text")]), 256)
    f = f.select("id", "path", F.coalesce("text", F.lit("")).alias("text"), rid.alias("rid"))
    found = settle(own(f.select("rid", "text"), templates))
    told = f.select("id", "path", "rid").join(found, "rid", "left")
    named = F.coalesce(F.lower("path").rlike(NAMED), F.lit(False))
    told = told.withColumn("license_file", F.col("license").isNotNull() & (named | F.coalesce("like_file", F.lit(False))))
    told = settle(told.withColumn("dir", directory(F.col("path"))))

    licensed = told.where("license_file and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("less"), F.col("license").alias("license"))).alias("b")).select(F.col("dir").alias("above"), F.col("b.license").alias("inherited"))
    dirs = told.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    steps = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    ladder = dirs.select("dir", F.explode(F.array_distinct(steps)).alias("above"))
    nearest = ladder.join(licensed, "above").groupBy("dir").agg(F.max_by("inherited", F.length("above")).alias("inherited"))
    out = told.join(nearest, "dir", "left")
    source = F.when(F.col("license").isNotNull(), "notice").when(F.col("inherited").isNotNull(), "directory")
    return out.select("id", "path", "license", "cosine", "license_file", "inherited", source.alias("license_from"))
