"""Canonical digest lookup: whole texts, normalised, hashed, and joined to the digests of known licences.

Normalising makes spellings of one text equal: lower case, copyright statements and "all rights reserved" lines gone,
equivalent words unified, punctuation and white space reduced to single spaces.  What is left is hashed; a
licence is recognised only if the entire text is the licence.  All of it is built-in expressions on the JVM.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick

# Equivalent spellings in the manner of the SPDX matching guidelines (variant, canonical).
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("honour", "honor"),
    ("initialise", "initialize"),
    ("licence", "license"),
    ("merchantable", "merchantability"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("recognised", "recognized"),
    ("sub license", "sublicense"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

#: Ordered (pattern, replacement) steps on the lower-cased text.  They use no lookaround and name their characters, so that
#: they mean the same in Java, Python and RE2; lines end at \\n alone.
#: A copyright line is a statement: the word followed by (c), a year or a holder.  Lines that a wrap makes begin with the
#: word (copyright notice, copyright holders be liable) go on with one of these words: they are marked first, and stay.
CONTINUED = r"(?:holders?|owners?|ownership|notices?|licen[sc]e[sd]?|laws?|statements?|interests?|acts?|and|or|on|to|in|of|for|is|as|if|at|are|was|be|that|this|it|its|which|with|under|from|not|does|you|we|may|shall|will|rights?|protection|infringement|claims?|disclaimers?|permissions?|treaty|treaties|management|restrictions?|doctrines?|status|information|legend|year|years|resulting|licensees?|assignment|assigned|registration|policy|material|the (?:software|library|program|work|package))"
HEAD = r"^[^0-9a-z\n]*"
MARK = (HEAD.replace("^", "^(") + r")copyright([ \t:]+" + CONTINUED + r")([^0-9a-z_]|$)", "\\1copyright\x01\\2\\3")
COPYRIGHT = HEAD + r"(?:copyright[ \t:]*(?:\(c\)|©|[0-9]{4})|copyright[ \t:]+[^ \t\r\n\f\x0B0-9:]|\(c\)[ \t]*(?:copyright[^0-9a-z_\n]|copyright$|[0-9]{4})|©)[^\n]*$"
RIGHTS = HEAD + r"all rights reserved[^\n]*$"
STEPS = [MARK, (COPYRIGHT, " "), (RIGHTS, " "), (r"[^0-9a-z\x{80}-\x{10FFFF}]+", " ")]

# Published licence texts and notices, whole.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC0-1.0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
}

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_AS_IS = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
MORE = {"BSD-2-Clause": _BSD + _BSD_AS_IS, "BSD-3-Clause": _BSD + _BSD_NAMES + _BSD_AS_IS}

# Title lines under which repositories ship the texts.
TITLES = {
    "MIT": ["MIT", "MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License", "MIT License (Expat)"],
    "ISC": ["ISC", "ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "0BSD": ["0BSD", "Zero-Clause BSD", "BSD Zero Clause License", "Zero-Clause BSD License", "Zero-Clause BSD License (0BSD)", "BSD Zero Clause License (0BSD)"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License", "zlib License (Zlib)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD-3-Clause", "New BSD License", "Modified BSD License", "BSD License"],
}

# Canonical digests of long texts, as distributed in /usr/share/common-licenses.
LONG = {
    "Apache-2.0": "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6",
    "Artistic-1.0-Perl": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    "BSD-3-Clause": "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",
    "CC0-1.0": "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    "GFDL-1.2": "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f",
    "GFDL-1.3": "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7",
    "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0": "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "7197bf24a2795592ac6dc2bdf3ad20f364fb9e61d2c8d749f267dda416714bb1",
    "MPL-2.0": "3599de37bcef5820a1933fc9b0c5b5389b95fa5dc39cb6e05f4764ef1c2f2439",
}


def canonical(text: str) -> str:
    """The normal form in Python, for the few known texts."""
    text = text.translate({c: c + 32 for c in range(65, 91)})
    for pattern, to in STEPS:
        text = re.sub("(?m)" + pattern.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff"), to, text)
    for variant, form in EQUIVALENT:
        text = text.replace(variant, form)
    return text.strip(" ")


def canonical_column(text: Column) -> Column:
    out = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for pattern, to in STEPS:
        out = F.regexp_replace(out, "(?md)" + pattern, to.replace("\\", "$"))
    for variant, form in EQUIVALENT:
        out = F.replace(out, F.lit(variant), F.lit(form))
    return F.trim(out)


def digest(text: str) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


def known_digests() -> list[tuple[str, str]]:
    """(digest, license_id) of the texts, bare and under their titles, and of the long texts."""
    texts = [(f"{title}\n\n{t}", name) for name, t in (KNOWN | MORE).items() for title in ["", *TITLES.get(name, [])]]
    return [*((digest(t), name) for t, name in texts), *((d, name) for name, d in LONG.items())]


def license_matches(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 100_000) -> DataFrame:
    """Rows (doc_id, n_chars, canonical_sha256, license_id), one per input row; license_id is null for other texts.

    known: (digest, license_id), by default the texts above.  It is broadcast when it has at most broadcast_rows
    rows, a bound that is counted first, and joined by shuffle else.  Digests are deduplicated, smallest name first.  Null
    and empty texts (and texts of punctuation alone) match nothing.  Repeated rows repeat; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    known = known if known is not None else spark.createDataFrame(known_digests(), "digest string, license_id string")
    known = known.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    if known.limit(broadcast_rows + 1).count() <= broadcast_rows:
        known = F.broadcast(known)
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("canonical", canonical_column(F.col("text")))
    rows = rows.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.sha2(F.encode("canonical", "utf-8"), 256).alias("canonical_sha256"), (F.col("canonical") != "").alias("some"))
    hit = (rows.canonical_sha256 == known.digest) & rows.some
    return rows.join(known, hit, "left").select("doc_id", "n_chars", "canonical_sha256", "license_id")


def license_sql(documents: str = "documents") -> str:
    """The same in DuckDB SQL over a relation of (doc_id, text)."""
    text = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern, to in STEPS:
        text = f"regexp_replace({text}, {quote('(?m)' + pattern)}, {quote(to)}, 'g')"
    for variant, form in EQUIVALENT:
        text = f"replace({text}, {quote(variant)}, {quote(form)})"
    rows = ", ".join(f"({quote(d)}, {quote(n)})" for d, n in known_digests())
    return (
        f"WITH listed(digest, name) AS (VALUES {rows}), known AS (SELECT digest, min(name) AS license_id FROM listed GROUP BY digest), c AS (SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, trim({text}, ' ') AS canonical FROM {documents}) "
        "SELECT c.doc_id, c.n_chars, sha256(c.canonical) AS canonical_sha256, k.license_id FROM c LEFT JOIN known k ON k.digest = sha256(c.canonical) AND c.canonical <> ''"
    )


def spellings(nations: DataFrame) -> DataFrame:
    """(doc_id, text): a licence text for each nation, which holds the copyright, in changing case and wrapping."""
    texts = [*(KNOWN | MORE).values()]
    listed = F.array(*map(F.lit, texts))
    body = F.get(listed, (F.col("n_nationkey") % len(texts)).cast("int"))
    form = F.col("n_nationkey") % 3
    body = F.when(form == 0, F.upper(body)).when(form == 1, F.replace(F.replace(body, F.lit(" copyright "), F.lit("\ncopyright ")), F.lit(" COPYRIGHT "), F.lit("\n * COPYRIGHT "))).otherwise(F.replace(body, F.lit(", "), F.lit(",\n\t")))
    return nations.select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit("Copyright (c) 2020 "), "n_name", F.lit("\nCopyright "), "n_name", F.lit(" and others\nAll rights reserved.\n\n"), body).alias("text"))


def spellings_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    texts = [*(KNOWN | MORE).values()]
    body = f"[{', '.join(map(quote, texts))}][n_nationkey % {len(texts)} + 1]"
    form = f"CASE n_nationkey % 3 WHEN 0 THEN upper({body}) WHEN 1 THEN replace(replace({body}, ' copyright ', '\ncopyright '), ' COPYRIGHT ', '\n * COPYRIGHT ') ELSE replace({body}, ', ', ',\n\t') END"
    return license_sql(f"(SELECT n_nationkey AS doc_id, 'Copyright (c) 2020 ' || n_name || '\nCopyright ' || n_name || ' and others\nAll rights reserved.\n\n' || {form} AS text FROM nation) AS made")
