"""Licence scan by canonical digests, in DataFrame functions only.

A text is put in canonical form (case, punctuation, white space, copyright lines, equivalent
spellings), hashed, and joined by its digest with the digests of known licence texts. The units
that are looked up are whole documents, paragraphs and lines: an entire unit has to be a known
text.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.shared import ids_and_texts

# Public licence texts and notices.
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies. "
)
_0BSD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License."
)
_GPL3 = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
)
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _GRANT + _WARRANTY),
    ("MIT", "MIT License " + _GRANT + _WARRANTY),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC + _AS_IS),
    ("0BSD", _0BSD + _AS_IS),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", _GPL3),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)
#: Spellings that count as one, applied in order to lower-case text.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("noncommercial", "non-commercial"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("https:", "http:"),
)
#: A line that opens with a copyright sign or word, or reserves all rights.
COPYRIGHT_LINE = r"(?dm)^[\x20\t]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
PUNCTUATION = r"[!-/:-@\[-`{-~©“”‘’«»–—\x20\t\r\f\x0b]+"


def canonical(text: Column) -> Column:
    """The canonical form with its line breaks; runs of other separators are one blank."""
    low = F.lower(text)
    for old, new in SPELLINGS:
        low = F.replace(low, F.lit(old), F.lit(new))
    plain = F.regexp_replace(F.regexp_replace(low, COPYRIGHT_LINE, ""), PUNCTUATION, " ")
    return F.regexp_replace(plain, r" *\n *", "\n")


def _flat(form: Column) -> Column:
    return F.trim(F.regexp_replace(form, r"[ \n]+", " "))


def known_digests(docs: DataFrame, known: Iterable[tuple[str, str]] = KNOWN) -> DataFrame:
    """``digest, license``: one row per known canonical text."""
    table = docs.sparkSession.createDataFrame(list(known), "license string, body string")
    return table.select(F.sha2(_flat(canonical(F.col("body"))), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: Iterable[tuple[str, str]] = KNOWN) -> DataFrame:
    """``doc_id, license, scope, n_units``: units of each document that are a known text.

    ``scope`` is text, paragraph or line; a document of a single line is found as all three.
    Null and empty texts have no units, repeated rows of an id add up, and other columns play
    no part. The known texts are a table of fixed size, sent to every task.
    """
    own = ids_and_texts(docs).select("doc_id", canonical(F.col("text")).alias("form"))
    line = F.transform(F.split("form", "\n"), lambda x: F.struct(F.lit("line").alias("scope"), F.trim(x).alias("unit")))
    paragraph = F.transform(F.split("form", "\n\n+"), lambda x: F.struct(F.lit("paragraph").alias("scope"), _flat(x).alias("unit")))
    whole = F.array(F.struct(F.lit("text").alias("scope"), _flat(F.col("form")).alias("unit")))
    units = own.select("doc_id", F.explode(F.concat(whole, paragraph, line)).alias("u")).where(F.length("u.unit") > 0)
    hashed = units.select("doc_id", "u.scope", F.sha2("u.unit", 256).alias("digest"))
    return hashed.join(F.broadcast(known_digests(docs, known)), "digest").groupBy("doc_id", "license", "scope").agg(F.count("*").alias("n_units"))
