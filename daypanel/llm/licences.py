"""Licences by canonical digest; built-in functions only.

A text is brought to a canonical form: lower case, lines that only say whose work it is removed, equivalent spellings made
one, everything but ASCII letters, digits and line ends a space, lines without words left out. Entire texts are joined by
digest to the known ones, and so is every run of consecutive lines that may be one, since notices and whole licences stand
within documents, wrapped and parted into paragraphs in any way.

Which runs may be one follows from the table of known texts and from nothing else: a run that equals a known text starts
with its first two words and has its length. So a regular expression of all beginnings finds the lines where a run may
start, and of each such line the runs that end with a line and are as long as a known text are hashed. Nothing that could
match is left out.

The table is an argument, ``(licence, body)``, with ``KNOWN`` as its default: licences in full without their heading,
notices, and SPDX lines. It is a list of texts that people have agreed on, at most ``MOST_KNOWN`` of them, and is
broadcast; what is gathered of it are beginnings and lengths. A whole text may also have the heading before the body.

Defined cases: null and empty texts have no licence, nor has a text of which nothing is left in canonical form; repeated
rows are treated alike; an empty table gives an empty result, and an empty table of known texts no licence to any row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daypanel.llm.common import saved, whole

MOST_KNOWN = 100_000

# Public licence texts without their headings, and the notices that stand for them.
NOTICES = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
TEXTS = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to '
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall "
        'be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED "
        '"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\nTHE "
        'SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("BSD-2-Clause", "{redistribution}\n{source}\n{binary}\n{disclaimer}"),
    ("BSD-3-Clause", "{redistribution}\n{source}\n{binary}\n{endorse}\n{disclaimer}"),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in "
        "a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions "
        "must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be "
        "removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software "
        "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
        "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
        "relinquishment in perpetuity of all present and future rights to this software under copyright law.\nTHE SOFTWARE IS PROVIDED "
        '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
        "USE OR OTHER DEALINGS IN THE SOFTWARE.\nFor more information, please refer to <https://unlicense.org>",
    ),
)
BSD = {
    "redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:",
    "source": "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.",
    "binary": "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.",
    "endorse": "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.",
    "disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO "
    "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
}
# Headings that may stand before a whole licence.
HEADINGS = (
    ("MIT", "MIT License"), ("MIT", "The MIT License"), ("MIT", "The MIT License (MIT)"), ("ISC", "ISC License"), ("ISC", "The ISC License"),
    ("0BSD", "BSD Zero Clause License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("Zlib", "zlib License"),
)
# Names of the SPDX list; those of the GNU licences stand for any of their endings.
SPDX = "MIT ISC 0BSD Apache-2.0 MPL-2.0 BSD-2-Clause BSD-3-Clause Zlib Unlicense BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 EPL-2.0 EUPL-1.2 WTFPL".split()
SPDX_GNU = "GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0".split()
KNOWN = (
    *NOTICES,
    *((name, body.format(**BSD)) for name, body in TEXTS),
    *((name, f"SPDX-License-Identifier: {name}") for name in SPDX),
    *((name, f"SPDX-License-Identifier: {name}{end}") for name in SPDX_GNU for end in ("", "-only", "-or-later")),
)
# Spellings that mean the same, as (pattern, plain form), applied in this order to lower-case text.
EQUIVALENT = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non-?infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    ("&", " and "),
    ("version |v\\. ?", "version "),
    ("https?://", ""),
)
# Fixed value: a line that only says whose work it is.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright[ \t]*(\(c\)|©|[0-9<\[{]|by )|\(c\)|©|all rights reserved)[^\n]*"


def canonical(text: Column) -> Column:
    """Words parted by single spaces, and by line ends where the text has them; no line is empty."""
    t = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "\n")
    for pattern, plain in EQUIVALENT:
        t = F.regexp_replace(t, pattern, plain)
    return F.btrim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9\n]+", " "), "[ ]?\n[ \n]*", "\n"), F.lit(" \n"))


def _flat(canonical_text: Column) -> Column:
    return F.translate(canonical_text, "\n", " ")


def known_table(spark: SparkSession) -> DataFrame:
    """``KNOWN`` as a table."""
    return spark.createDataFrame(list(KNOWN), "licence string, body string")


def _forms(known: DataFrame) -> DataFrame:
    """``(licence, form, digest)`` of the known texts; what is known twice under one name counts once."""
    form = _flat(canonical(F.col("body")))
    return known.select("licence", form.alias("form")).filter("form <> ''").distinct().withColumn("digest", F.sha2("form", 256))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, ``whole_licence`` (the entire text is that licence, with or without a heading),
    ``licences`` (sorted names, comma-joined, of all licences that the text or a run of its lines is) and ``n_notices``
    (places of the text where one stands)."""
    spark = docs.sparkSession
    forms = saved(_forms(known_table(spark) if known is None else known.select("licence", "body")))
    facts = forms.agg(
        F.count("*").alias("n"),
        F.collect_set(F.substring_index("form", " ", 2)).alias("beginnings"),
        F.array_sort(F.collect_set(F.char_length("form"))).alias("lengths"),
    ).first()
    if facts.n > MOST_KNOWN:
        raise ValueError(f"{facts.n} known texts are no list of licences")
    # Of a line that begins like a known text, the line and as much behind it as the longest known text has.
    starts = "|".join(re.escape(x).replace("\\ ", "[ \\n]") for x in sorted(facts.beginnings)) or "[^\\s\\S]"
    most = max(facts.lengths, default=0)
    lengths = F.array(*map(F.lit, facts.lengths)).cast("array<int>")
    t = F.col("_t")
    found = F.regexp_extract_all(t, F.lit(f"(?=(?:^|\\n)((?:{starts})(?![a-z0-9])[\\s\\S]{{0,{most}}}))"), F.lit(1))

    def runs(chunk: Column) -> Column:
        ends = lambda n: (F.char_length(chunk) == n) | (F.substring(chunk, n + 1, F.lit(1)) == "\n")
        return F.transform(F.filter(lengths, ends), lambda n: F.sha2(_flat(F.substring(chunk, F.lit(1), n)), 256))

    rows = saved(
        docs.select(F.col(f"`{id_col}`").alias("_id"), canonical(whole(f"`{text_col}`")).alias("_t"))
        .select(
            "_id",
            F.when(F.char_length(t) <= most + HEADING_ROOM, F.sha2(_flat(t), 256)).alias("_whole"),
            F.flatten(F.transform(found, runs)).alias("_runs"),
        )
        .withColumn("_row", F.monotonically_increasing_id())
    )
    headings = spark.createDataFrame(list(HEADINGS), "licence string, heading string")
    headed = headings.join(forms.filter(F.char_length("form") > HEADED), "licence").select(
        "licence", F.sha2(F.concat_ws(" ", _flat(canonical(F.col("heading"))), F.col("form")), 256).alias("digest")
    )
    entire = forms.select("licence", "digest").unionByName(headed).groupBy("digest").agg(F.min("licence").alias("whole_licence"))
    hits = (
        rows.select("_row", F.explode("_runs").alias("digest"))
        .join(F.broadcast(forms.groupBy("digest").agg(F.collect_set("licence").alias("_own"))), "digest")
        .groupBy("_row")
        .agg(F.array_distinct(F.flatten(F.collect_list("_own"))).alias("_names"), F.count("*").alias("_n"))
    )
    none = F.array().cast("array<string>")
    names = F.array_distinct(F.concat(F.coalesce("_names", none), F.array_compact(F.array("whole_licence"))))
    whole_hit = F.broadcast(entire.withColumnRenamed("digest", "_whole"))
    return rows.join(hits, "_row", "left").join(whole_hit, "_whole", "left").select(
        F.col("_id").alias(id_col),
        "whole_licence",
        F.array_join(F.array_sort(names), ",").alias("licences"),
        F.coalesce("_n", F.lit(0)).alias("n_notices"),
    )


#: characters of the longest heading; known texts of more characters than this are licences in full and may have one
HEADING_ROOM, HEADED = 40, 200
