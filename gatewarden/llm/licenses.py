"""License scans by canonical digest lookup (operator 7).

A text is brought to a canonical form (lower case, equivalent spellings, no
copyright lines, punctuation as blanks, single blanks), hashed, and hash-joined
to the digests of known licence texts, made the same way.  The whole document is
looked up as one text; so is each of its lines and sentences, which finds the
one-sentence notices that name a licence.  A line or sentence is only hashed where
its first two words are those of a known text, or where one of the phrases stands in
it that a known text may start with behind a copyright: no other can be one.

Defined results: null text, and a text that is empty in canonical form, has no
digest and no licence; a text that only holds part of a licence has none.  Rows
alike in doc_id and text are rows of their own with the same result.  An empty
table gives an empty result.  Only built-in expressions run.
"""

from __future__ import annotations

import pkgutil
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, same

#: Whole texts shipped as files of ``license_texts``: (licence, file).
FILES = [
    ("Apache-2.0", "Apache-2.0"),
    ("CC0-1.0", "CC0-1.0"),
    ("GPL-2.0", "GPL-2"),
    ("GPL-3.0", "GPL-3"),
    ("LGPL-2.1", "LGPL-2.1"),
    ("LGPL-3.0", "LGPL-3"),
    ("MPL-2.0", "MPL-2.0"),
]
#: Files also come without the appendix behind this line.
TERMS_END = "END OF TERMS AND CONDITIONS"

# Equivalent spellings, longer first where one is part of another.
SPELLINGS = [
    ("sub-licence", "sublicense"),
    ("sub-license", "sublicense"),
    ("sublicence", "sublicense"),
    ("licence", "license"),
    ("copyright holder", "copyright owner"),
    ("merchantibility", "merchantability"),
    ("non-infringement", "noninfringement"),
    ("non-commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("per cent", "percent"),
    ("https://", "http://"),
]

# Names by which notices call each licence (SPDX identifier first).
NAMES = {
    "MIT": ["MIT", "the MIT License", "MIT License"],
    "Apache-2.0": ["Apache-2.0", "the Apache License, Version 2.0", "Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0"],
    "GPL-3.0": ["GPL-3.0", "the GNU General Public License, version 3", "GNU General Public License, version 3", "the GNU General Public License v3", "the GPLv3"],
    "GPL-2.0": ["GPL-2.0", "the GNU General Public License, version 2", "GNU General Public License, version 2", "the GNU General Public License v2", "the GPLv2"],
    "LGPL-3.0": ["LGPL-3.0", "the GNU Lesser General Public License, version 3", "the LGPLv3"],
    "AGPL-3.0": ["AGPL-3.0", "the GNU Affero General Public License, version 3", "the AGPLv3"],
    "MPL-2.0": ["MPL-2.0", "the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"],
    "BSD-2-Clause": ["BSD-2-Clause", "the BSD 2-Clause License", "the 2-Clause BSD License"],
    "BSD-3-Clause": ["BSD-3-Clause", "the BSD 3-Clause License", "the 3-Clause BSD License"],
    "ISC": ["ISC", "the ISC License"],
    "CC0-1.0": ["CC0-1.0", "CC0 1.0", "CC0"],
    "CC-BY-4.0": ["CC-BY-4.0", "CC BY 4.0", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC-BY-SA-4.0", "CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC-BY-NC-4.0", "CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC-BY-ND-4.0", "CC BY-ND 4.0", "the Creative Commons Attribution-NoDerivatives 4.0 International License"],
}
FORMS = [
    "Licensed under {}",
    "Released under {}",
    "Distributed under {}",
    "Available under {}",
    "Published under {}",
    "This work is licensed under {}",
    "This file is licensed under {}",
    "This project is licensed under {}",
    "This software is licensed under {}",
    "This software is released under {}",
    "This program is licensed under {}",
    "SPDX-License-Identifier: {}",
    "License: {}",
]

# Whole texts of short public licences (their wording is their identity).
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
}

_BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{}Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

{}Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.

{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_NAMES = """{}Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.

"""
# The BSD texts, with numbered and with unnumbered conditions.
BSD_TEXTS = [
    ("BSD-2-Clause", _BSD.format("1. ", "2. ", "")),
    ("BSD-2-Clause", _BSD.format("", "", "")),
    ("BSD-3-Clause", _BSD.format("1. ", "2. ", _BSD_NAMES.format("3. "))),
    ("BSD-3-Clause", _BSD.format("", "", _BSD_NAMES.format(""))),
]
# Title lines that files put above the texts.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "0BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License"],
}
# In a text reflowed into one line the title ends where the copyright starts, and the
# copyright where one of the known texts starts.
TITLE_END = r"^(\s*(?:{}))\s+(?=copyright\b|\(c\)|©)".format("|".join(re.escape(t.lower()) for ts in TITLES.values() for t in ts))
STARTS = ["permission is hereby granted, free", "permission to use, copy, modify", "redistribution and use in source"]
COPYRIGHT_END = r"(?m)^([^\p{L}\n(©]*(?:copyright\b|\(c\)|©)[^\n]*?)" + r"(?=\b(?:{}))".format("|".join(STARTS))

COPYRIGHT_LINE = r"(?m)^[^\p{L}\n(©]*(?:copyright\b|\(c\)|©)(?:[^\n]*\d{4}|[ \t]*(?:\(c\)|©))[^\n]*$"
NO_WORD = r"[^\p{L}\p{N}]+"
SENTENCE_END = r"([.!?])[ \t]+"

MAX_BROADCAST_DIGESTS = 200_000
#: Up to so many different beginnings of known texts are tested before hashing.
MAX_BEGINNINGS = 1_000


def file_texts() -> list[tuple[str, str]]:
    """(licence, text) of the shipped files, whole and up to the end of their terms."""
    out = []
    for spdx, name in FILES:
        text = pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode("utf-8")
        out.append((spdx, text))
        if TERMS_END in text:
            out.append((spdx, text[: text.index(TERMS_END) + len(TERMS_END)]))
    return out


def known_texts() -> list[tuple[str, str]]:
    """(licence, text): whole texts, and every notice form with every name."""
    notices = [(spdx, form.format(name)) for spdx, names in NAMES.items() for name in names for form in FORMS]
    return list(TEXTS.items()) + file_texts() + notices


def titled_texts() -> list[tuple[str, str]]:
    """(licence, text): the BSD texts, and every whole text under each of its titles."""
    plain = list(TEXTS.items()) + BSD_TEXTS
    return BSD_TEXTS + [(spdx, f"{title}\n\n{text}") for spdx, text in plain for title in TITLES[spdx]]


def usual_spelling(text: Column) -> Column:
    """Lower case, equivalent spellings: the same for a text and for its parts."""
    t = F.lower(text)
    for spelling, usual in SPELLINGS:
        t = F.replace(t, F.lit(spelling), F.lit(usual))
    return t


def bare(t: Column) -> Column:
    """Canonical form of a text in usual spelling; null where nothing is left."""
    t = F.regexp_replace(F.regexp_replace(t, TITLE_END, "$1\n"), COPYRIGHT_END, "$1\n")
    # A copyright line starts with the word or the sign and says no more than who and when.
    t = F.regexp_replace(t, COPYRIGHT_LINE, " ")
    t = F.trim(F.regexp_replace(t, NO_WORD, " "))
    return F.when(t != "", t)


def canonical(text: Column) -> Column:
    """Canonical form; null where nothing is left."""
    return bare(usual_spelling(text))


def digest(text: Column) -> Column:
    return F.md5(canonical(text).cast("binary"))


def known_digests(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """digest, license, beginning (the first two words): one row per digest (the first
    licence by name where two agree)."""
    rows = spark.createDataFrame(known, "license string, text string").select("license", canonical(F.col("text")).alias("text")).filter("text is not null")
    beginning = F.substring_index("text", " ", 2).alias("beginning")
    return rows.groupBy(F.md5(F.col("text").cast("binary")).alias("digest"), beginning).agg(F.min("license").alias("license"))


def may_be_known(unit: Column, beginnings: list[str]) -> Column:
    """False only for one-line texts in usual spelling whose canonical form starts with
    none of ``beginnings`` (one or two words).  What a canonical form leaves out of one
    line is its end, or a copyright before one of ``STARTS``, or one behind a title of
    two or more words: so it keeps the first two words, or the line holds a start."""
    words = "|".join(NO_WORD.join(re.escape(w) for w in b.split(" ")) for b in sorted(beginnings))
    test = unit.rlike(rf"^(?:{NO_WORD})?(?:{words})(?![\p{{L}}\p{{N}}])") if beginnings else F.lit(False)
    for start in STARTS:
        test = test | unit.contains(start)
    return test


def units(text: Column) -> Column:
    """Lines, and sentences within them where a line has several."""
    return F.split(F.regexp_replace(text, SENTENCE_END, "$1\n"), "\n")


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, license (of the whole text, else null), notices (licences of
    its lines and sentences, comma-separated in order, else null) and n_notices."""
    known = known_texts() + titled_texts() if known is None else known
    table = cut(known_digests(docs.sparkSession, known))
    beginnings = [r.beginning for r in table.select("beginning").distinct().limit(MAX_BEGINNINGS + 1).collect()]
    # The list comes from the caller; broadcast up to a fixed length, shuffled beyond.
    small = (lambda d: F.broadcast(d)) if len(known) <= MAX_BROADCAST_DIGESTS else (lambda d: d)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("row"), F.crc32(text).alias("crc"), usual_spelling(text).alias("text"))
    whole = rows.select("doc_id", "row", "crc", F.md5(bare(F.col("text")).cast("binary")).alias("digest"))
    parts = rows.select("doc_id", "row", "crc", F.posexplode(units(F.col("text"))).alias("k", "unit"))
    if len(beginnings) <= MAX_BEGINNINGS:
        parts = parts.filter(may_be_known(F.col("unit"), beginnings))
    parts = parts.withColumn("d", F.md5(bare(F.col("unit")).cast("binary"))).select("doc_id", "row", "crc", "k", "d")
    hits = parts.join(small(table.select(F.col("digest").alias("kd"), "license")), F.col("d") == F.col("kd"))
    # The same place of rows alike in doc_id and text counts once.
    hits = hits.select("doc_id", "row", "crc", "k", "license").distinct().groupBy("doc_id", "row", "crc")
    hits = cut(hits.agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"), F.count(F.lit(1)).alias("n_notices")))
    hits = hits.select(F.col("doc_id").alias("hi"), F.col("row").alias("hr"), F.col("crc").alias("hc"), "notices", "n_notices")
    out = whole.join(small(table.select(F.col("digest").alias("kd"), "license")), F.col("digest") == F.col("kd"), "left")
    out = out.join(hits, same(F.col("doc_id"), F.col("hi")) & (F.col("row") == F.col("hr")) & (F.col("crc") == F.col("hc")), "left")
    return out.select("doc_id", "digest", "license", "notices", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))
