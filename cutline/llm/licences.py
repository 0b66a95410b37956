"""Licence scan by canonical digests.

A text and each of its lines are normalised (case, copyright lines, punctuation, equivalent
spellings, white space) and hashed; the digests are joined with those of known licence texts and
notices. Only entire texts and entire lines match, so a mention inside a sentence does not.
DataFrame operations only. The known table is small and fixed, so Spark broadcasts it by itself.

Whole texts lie in ``licence_texts.jsonl``; each counts with and without its appendix, short ones
also after the usual title lines and wrapped at the usual widths.
"""

from __future__ import annotations

import json
import pkgutil
import re
import textwrap
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts (without copyright lines) and notices in common use.
NOTICES = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD "
        "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
        "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO "
        "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
        "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY "
        "OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN "
        "IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
        "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed "
        "or altered from any source distribution.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
)

# Spellings that count as equal, applied in this order.
SAME = (("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("https://", "http://"), ("&", " and "), ("v. ", "version "))

COPYRIGHT = r"(^|\n)[ \t]*(?:copyright|\(c\)|©)[^\n]*"


# Lines that stand above short texts.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
    "Unlicense": ("Unlicense", "The Unlicense"),
}
RESERVED = "All rights reserved."
WIDTHS = range(60, 101)


def _wrapped(text: str) -> list[str]:
    """The text and its forms at each width that differ: a line that a wrap begins with
    "copyright" is lost as a copyright line is."""

    def at(width: int) -> str:
        return "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in re.split(r"\n\s*\n", text))

    forms = {" ".join(re.sub(COPYRIGHT, "\n", form.lower()).split()): form for form in [*map(at, WIDTHS), text]}
    return list(forms.values())


def _whole() -> list[tuple[str, str]]:
    """(licence, text) of every form of the whole texts."""
    texts = [json.loads(line) for line in pkgutil.get_data(__package__, "licence_texts.jsonl").decode().splitlines()]
    texts += [{"licence": a, "text": b, "tail": ""} for a, b in NOTICES if a == "Zlib"]
    out = []
    for x in texts:
        titles = ("", *TITLES.get(x["licence"], ()))
        bodies = _wrapped(x["text"]) if len(titles) > 1 else [x["text"]]
        reserved = ("", RESERVED) if len(titles) > 1 else ("",)
        for title, right, body, tail in product(titles, reserved, bodies, dict.fromkeys(("", x["tail"]))):
            out.append((x["licence"], "\n\n".join(part for part in (title, right, body, tail) if part)))
    return out


KNOWN = (*NOTICES, *_whole())


def canonical(text: Column) -> Column:
    """The text in lower case, without copyright lines, in equal spellings, letters and digits only."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT, "\n")
    for a, b in SAME:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def known_digests(spark: SparkSession, known: tuple = KNOWN) -> DataFrame:
    """(licence, digest) of the known texts; texts that are equal once normalised count once."""
    rows = spark.createDataFrame(list(known), "licence string, text string")
    return rows.select("licence", F.md5(canonical(F.col("text")).cast("binary")).alias("digest")).distinct()


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and licence found: doc_id, licence, whole_text, lines.

    ``whole_text``: the entire text is that licence; ``lines``: lines that are one of its texts.
    Null and empty texts, and lines without letters or digits, match nothing; rows that share an
    id count together. Other columns are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    units = F.concat(
        F.array(F.struct(F.lit(True).alias("whole"), text.alias("unit"))),
        F.transform(F.split(text, "\n"), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit"))),
    )
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.explode(units).alias("u")).select("doc_id", "u.whole", canonical(F.col("u.unit")).alias("c"))
    rows = rows.filter("c != ''").select("doc_id", "whole", F.md5(F.col("c").cast("binary")).alias("digest"))
    found = rows.join(known, "digest").groupBy("doc_id", "licence")
    return found.agg(F.max("whole").alias("whole_text"), F.sum(F.when(F.col("whole"), 0).otherwise(1)).cast("bigint").alias("lines"))


def scan_sql(known: tuple = KNOWN) -> str:
    """The same scan of ``documents`` as SQL."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def normal(x: str) -> str:
        out = f"regexp_replace(lower({x}), {quoted(COPYRIGHT)}, chr(10), 'g')"
        for a, b in SAME:
            out = f"replace({out}, {quoted(a)}, {quoted(b)})"
        return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in known)
    return f"""
    WITH known AS (SELECT DISTINCT licence, md5({normal('t')}) AS digest FROM (VALUES {values}) k(licence, t)),
    units AS (SELECT doc_id, true AS whole, text AS u FROM documents UNION ALL
              SELECT doc_id, false, unnest(string_split(coalesce(text, ''), chr(10))) FROM documents),
    canon AS (SELECT doc_id, whole, {normal('u')} AS c FROM units)
    SELECT doc_id, licence, bool_or(whole) AS whole_text, CAST(sum(CASE WHEN whole THEN 0 ELSE 1 END) AS BIGINT) AS lines
    FROM canon JOIN known ON md5(c) = digest WHERE c <> '' GROUP BY doc_id, licence
    """
