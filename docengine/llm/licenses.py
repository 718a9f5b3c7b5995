"""Licence scan by canonical digests (operator 3), built-in expressions only.

A text is made canonical: copyright lines (with a sign, a year, `by` or a name) and title lines (a licence name
alone) out, lower case, list marks and quotes out, other punctuation (comment marks too) as spaces, equivalent
spellings as one, white space collapsed. The digests of four kinds of entire texts are hash-joined to the digests
of known licence texts and notices: the document, runs of several blocks (between lines without content), single
blocks and lines. Only units as long as some known text are hashed, and a run of blocks only if its first word
begins a known text; both lose nothing. A run is as long as the longest known text at most.

A licence is found in a larger text if it stands between lines without content there (blank lines, comment marks,
copyright and title lines). Known notices are made by rule from licence names and notice forms; full texts and
standard headers are fixed values, of long licences only their digests are; who holds the rights in a BSD licence is a
slot. `known` can bring others (license string, body string). Up to MOST_BROADCAST
digests (counted first) are broadcast, more are shuffled; a unit is reported where it stands, so hot notices need
no gathering.

A null or empty text has no licence. Null ids are kept; repeated rows are reported as often as they come. A
document whose whole text is one line is reported at its widest scope only. Other columns are not carried over.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.operators.vectors import let

#: Digests (about 100 bytes each) that are broadcast.
MOST_BROADCAST = 100_000

# Names of licences by identifier, forms of notices ({} is the name), equivalent spellings, full texts.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause"],
    "ISC": ["ISC License", "ISC"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}
FORMS = [
    "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}", "Available under the {}", "License: {}", "SPDX-License-Identifier: {}",
    "This work is licensed under {}", "This work is licensed under the {}", "This work is licensed under a {}", "This software is licensed under the {}", "This program is licensed under the {}",
    "This project is licensed under the {}", "This code is released under the {}", "This file is distributed under the terms of the {}",
]
SPELLINGS = [
    (r"\blicence(s|d)?\b", "license$1"),
    (r"\bsub licen[cs]", "sublicens"),
    (r"\bnon commercial", "noncommercial"),
    (r"\bno derivatives\b", "noderivatives"),
    (r"\bshare alike\b", "sharealike"),
    (r"\b(?:version |v)(\d)", "version $1"),
    (r"\bfavour", "favor"),
    (r"\borganis", "organiz"),
    (r"\b(?:owner|holder)s?\b", "holder"),
    (r"\bhttps\b", "http"),
    (r"\bnon ?(\n?) ?infring", "$1noninfring"),
    (r"\band or distribute\b", "and distribute"),
    # who holds the rights: up to 120 characters on a line, or on the end of one and the beginning of the next
    (r"\b(neither\s+the\s+names?\s+of)\b[^\n]{0,120}?(\n?)[^\n]{0,120}?\s(\s*nor\s+the\s+names\s+of)\b", "$1 holder$2 $3"),
    (r"\b(this\s+software\s+is\s+provided\s+by)\b[^\n]{0,120}?(\n?)[^\n]{0,120}?\s(\s*as\s+is\s+and\s+any\s+express)\b", "$1 holder$2 $3"),
    (r"\b(in\s+no\s+event\s+shall)\b[^\n]{0,120}?(\n?)[^\n]{0,120}?\s(\s*be\s+liable\s+for\s+any\s+direct)\b", "$1 holder$2 $3"),
]
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
BSD_ITEMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
GNU_HEADER = """This {work} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.

This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
GNU_ENDS = [
    "You should have received a copy of the GNU {name} along with this {work}. If not, see <https://www.gnu.org/licenses/>.",
    "You should have received a copy of the GNU {name} along with this {work}; if not, see <https://www.gnu.org/licenses>.",
    "You should have received a copy of the GNU {name} along with this {work}; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "You should have received a copy of the GNU {name} along with this {work}; if not, write to the Free Software Foundation, Inc., 59 Temple Place, Suite 330, Boston, MA 02111-1307 USA",
]
GNU = {"GPL-2.0": ("program", "General Public License", "2"), "GPL-3.0": ("program", "General Public License", "3"), "LGPL-2.1": ("library", "Lesser General Public License", "2.1"), "LGPL-3.0": ("library", "Lesser General Public License", "3"), "AGPL-3.0": ("program", "Affero General Public License", "3")}

# Long licences by the length, first word and SHA-256 of their canonical form (`made`), with and without their appendix.
DIGESTS: list[tuple[str, int, str, str]] = [
    ("Apache-2.0", 9785, "version", "9776f638b8b176bcece494505c719bddc37995af7b4beb457d2c16ca93c82c64"),
    ("Apache-2.0", 8770, "version", "05df7626f78378517e2a4d09ae72278aea3f093e4833a3b6bd7042b425be9a68"),
    ("Apache-2.0", 8742, "version", "5e268946417747c20076d1a45aa2abcb38ba3f754ed432a232a6178e89238b57"),
    ("CC0-1.0", 6678, "creative", "bba148486c720ccd0153eb8a02dfb47618bd1a13b0bebb3726d3bcbe2755ed0d"),
    ("GPL-1.0", 11720, "gnu", "94ee7905ce10195cb3b56cfc1426b4fe74ed89b624eda32834ef01185e9db035"),
    ("GPL-1.0", 9372, "gnu", "494f8a4b06791904549b37b23f0956ed76753766e983ef8241d903bf80199873"),
    ("GPL-1.0", 9344, "gnu", "81265bc636e41e4348b50146200652fbb25ce63a2ce47f15c58402dbda7cbec5"),
    ("GPL-2.0", 17068, "gnu", "32dde62844914b9df8ac02df7242892c5763fd4e69971212bc4884d5a05c26a2"),
    ("GPL-2.0", 14435, "gnu", "1e8833652da777c13cf4f8427deae9535a19651e24285ba1b21dea8778689ac5"),
    ("GPL-2.0", 14407, "gnu", "23355ee7b35e7e9c0e7e457763f4fb10f4190632e25debc4f91f7f9139fbc11f"),
    ("GPL-3.0", 33314, "gnu", "f4a8b9d183cb6736ae3c8755e441eaba157f996e9fd3ec30a0ca8ba60943b598"),
    ("GPL-3.0", 30878, "gnu", "2499a507a6900dd7a0b7e79f2b6c02ebca367bd3db684bbdfe97b16d664f5f6a"),
    ("GPL-3.0", 30850, "gnu", "b2152afc5b1219963e73606bd8a0939ff661f7eb55461ec072c96fc7ca04f138"),
    ("LGPL-2.0", 24061, "gnu", "0df03c2b726ba87a8839f3d600e5633bca42f9f078fc235787ef18f4f0961c59"),
    ("LGPL-2.0", 22210, "gnu", "9102fbdf5da98c43d0dca1c1341846ab7f0f70deb97a31c4923d468b25b7f159"),
    ("LGPL-2.0", 22182, "gnu", "dee600d0f7b02f68638bc73c63e71e55d51ed44284e74535cf7e2313236fed27"),
    ("LGPL-2.1", 25146, "gnu", "a1b4c3f6c63f2f4217de7705d1813e5dac6d51beda0e51bfd977d8be120ee64f"),
    ("LGPL-2.1", 23296, "gnu", "ff43254caaebc24ded8c85f5fbc0d9a76c0c367bf8d63945eaa62dbc8fe9e2d8"),
    ("LGPL-2.1", 23268, "gnu", "425f0e043e825f285992e63cb753cf3a01959f5680a39f2d44a33a503cd4a317"),
    ("LGPL-3.0", 7062, "gnu", "3f491b55e24298bafe377f42facf48c8a16f555a7f6eb355ef84f059b7f60dda"),
    ("MPL-1.1", 22246, "mozilla", "331c2266a1346b11671ff0a529f0e0bfa35d49d670ace982a799fd791daa5c05"),
    ("MPL-2.0", 14190, "definitions", "3cad17e326fa9f37aad970a1d4a526c9c9dfe50970dd03301b8b55834253b2b8"),
    ("Artistic-1.0-Perl", 5613, "the", "0d04a9d18471e44acea3aeda7d0fa534640f255e9431c7780c1d372388da671e"),
    ("GFDL-1.2", 19552, "gnu", "291e4efeaa30869963db88d7a8b86a567ed0e642cecfc23d60a38c36c0da9bb1"),
    ("GFDL-1.3", 21980, "gnu", "d3679fc944c2ab9a202091789a5369080178e0a681846eb5aaef986dceb77b00"),
]

#: Canonical form: SQL regular expressions that read the same in Spark and in other engines; line feeds stay.
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n©]*(?:(?:(?i:copyright|copr)[^\p{L}\p{N}\n]*(?:(?i:c\b|by\b|year\b|yyyy\b)|[0-9]|[A-Z][a-z])|©|\((?i:c)\)|(?i:all rights reserved))[^\n]*|(?i:copyright)[^\p{L}\p{N}\n]*)$"
MARKS = r"(?m)^[^\p{L}\p{N}\n]*(?:[0-9]{1,2}[.)]|[a-z]\))[ \t]+"
INNER_MARKS = r"([:;.])[ \t]+[0-9]{1,2}[.)][ \t]+"
QUOTES = r"['\"`´‘’“”]"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"


def titles() -> list[str]:
    """Canonical lines that only name a licence."""
    plain = {" ".join("".join(c if c.isalnum() else " " for c in x.lower().replace("'", "")).split()) for names in [*NAMES.values(), ["Boost Software License", "Boost Software License Version 1 0", "zlib libpng License"]] for x in names}
    plain |= {f"{i.lower()} license" for i in ("MIT", "ISC", "BSD", "Apache", "zlib", "simplified bsd", "new bsd", "modified bsd")} | {"mit license mit", "isc license isc", "bsd 2 clause license", "bsd 3 clause license"}
    return sorted({y for x in plain for y in (x, f"the {x}", f"{x} license" if not x.endswith("license") else x)} - {"license"})


def known_texts() -> list[tuple[str, str]]:
    """(license, text): every form with every name, and the full texts."""
    notices = [(i, form.format(name)) for i, names in NAMES.items() for name in names for form in FORMS]
    gnu = [(i, f"{GNU_HEADER}\n\n{end}".format(work=w, name=name, version=v)) for i, (work, name, v) in GNU.items() for w in dict.fromkeys((work, "program")) for end in GNU_ENDS]
    bsd = [("BSD-2-Clause", f"{BSD_ITEMS}\n\n{BSD_DISCLAIMER}"), ("BSD-3-Clause", f"{BSD_ITEMS}\n\n{BSD_THIRD}\n\n{BSD_DISCLAIMER}")]
    return notices + list(TEXTS.items()) + bsd + gnu


def canonical_lines(text: Column) -> Column:
    """Canonical form of each line, in order; lines without content are empty."""
    s = F.regexp_replace(F.lower(F.regexp_replace(text, COPYRIGHT, "")), MARKS, "")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, INNER_MARKS, "$1 "), QUOTES, ""), PUNCTUATION, " ")
    for pattern, spelling in SPELLINGS:
        s = F.regexp_replace(s, pattern, spelling)
    named = titles()
    return F.transform(F.split(s, "\n", -1), lambda x: let(F.trim(x), lambda t: F.when(t.isin(named), "").otherwise(t)))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def canonical_sql(text: str) -> str:
    """The canonical lines as a SQL expression of DuckDB."""
    s = f"lower(regexp_replace({text}, {_quoted(COPYRIGHT)}, '', 'g'))"
    for pattern, put in [(MARKS, ""), (INNER_MARKS, "\\1 "), (QUOTES, ""), (PUNCTUATION, " "), *((p, r.replace("$", "\\")) for p, r in SPELLINGS)]:
        s = f"regexp_replace({s}, {_quoted(pattern)}, {_quoted(put)}, 'g')"
    return f"list_transform(string_split({s}, chr(10)), lambda x: CASE WHEN trim(x) IN ({', '.join(map(_quoted, titles()))}) THEN '' ELSE trim(x) END)"


def scan_sql(table: str = "documents") -> str:
    """`scan` of the default texts as SQL (ids must be unique)."""
    values = ", ".join("({}, {})".format(*map(_quoted, pair)) for pair in known_texts())
    listed = ", ".join(f"({_quoted(i)}, {size}, {_quoted(word)}, {_quoted(digest)})" for i, size, word, digest in DIGESTS)
    return f"""WITH raw(license, body) AS (VALUES {values}),
    listed(license, size, word, digest) AS (VALUES {listed}),
    known AS (SELECT digest, min(license) AS license, max(size) AS size FROM (SELECT license, sha256(c) AS digest, length(c) AS size FROM (SELECT license, array_to_string(list_filter({canonical_sql("body")}, lambda x: x <> ''), ' ') AS c FROM raw) WHERE c <> ''
      UNION ALL SELECT license, digest, size FROM listed) GROUP BY digest),
    d AS (SELECT doc_id, {canonical_sql("text")} AS l FROM {table} WHERE text IS NOT NULL),
    f AS (SELECT * FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM d) WHERE x <> ''),
    b AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
    whole AS (SELECT doc_id, min(i) AS a, max(i) - min(i) + 1 AS n, string_agg(x, ' ' ORDER BY i) AS body, count(DISTINCT run) AS runs FROM b GROUP BY doc_id),
    runs AS (SELECT *, row_number() OVER w AS k, sum(length(body) + 1) OVER w AS upto FROM (SELECT doc_id, min(i) AS a, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS body FROM b GROUP BY doc_id, run) WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
    pairs AS (SELECT p.doc_id, p.a, q.a + q.n - p.a AS n, p.k AS first, q.k AS last FROM runs p JOIN whole w USING (doc_id) JOIN runs q ON q.doc_id = p.doc_id AND q.k > p.k AND q.k < p.k + (SELECT greatest(2, max(size) // 2) FROM known)
      WHERE q.upto - p.upto + length(p.body) IN (SELECT size FROM known) AND q.k - p.k + 1 < w.runs),
    u AS (SELECT doc_id, 'document' AS scope, a, n, body FROM whole
      UNION ALL SELECT s.doc_id, 'blocks', s.a, s.n, string_agg(r.body, ' ' ORDER BY r.k) FROM pairs s JOIN runs r ON r.doc_id = s.doc_id AND r.k BETWEEN s.first AND s.last GROUP BY s.doc_id, s.a, s.n, s.first, s.last
      UNION ALL SELECT r.doc_id, 'block', r.a, r.n, r.body FROM runs r JOIN whole w USING (doc_id) WHERE w.runs > 1 AND r.n > 1
      UNION ALL SELECT b.doc_id, 'line', b.i, 1, b.x FROM b JOIN whole w USING (doc_id) WHERE w.runs > 1 OR w.n > 1)
    SELECT doc_id, license, scope, CAST(a AS INTEGER) AS first_line, CAST(n AS INTEGER) AS n_lines FROM u JOIN known ON digest = sha256(body)"""


def joined(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """license, digest, size (characters of the canonical text), word (its first): each digest once."""
    rows = spark.createDataFrame(known_texts(), "license string, body string")
    if known is not None:
        rows = rows.unionByName(known.select("license", "body"))
    listed = spark.createDataFrame(DIGESTS, "license string, size int, word string, digest string")
    return made(rows).unionByName(listed).groupBy("digest").agg(F.min("license").alias("license"), F.max("size").alias("size"), F.min("word").alias("word"))


def made(texts: DataFrame) -> DataFrame:
    """license, size, word, digest of texts (license, body): what DIGESTS lists of long ones."""
    canon = texts.select("license", joined(canonical_lines(F.col("body"))).alias("c")).where("c != ''")
    return canon.select("license", F.length("c").alias("size"), F.substring_index("c", " ", 1).alias("word"), F.sha2("c", 256).alias("digest"))


def scan(df: DataFrame, text: str = "text", id: str = "doc_id", known: DataFrame | None = None) -> DataFrame:
    """id, license, scope (document, blocks, block, line), first_line, n_lines (counted from 0) of each known text found."""
    table = digests(df.sparkSession, known)
    low, high, n, sizes, words = table.agg(F.min("size"), F.max("size"), F.count("*"), F.collect_set("size"), F.collect_set("word")).first()  # a row for each known text at most
    hashed = table.select("digest", "license")
    if n <= MOST_BROADCAST:
        hashed = F.broadcast(hashed)
    found = let(canonical_lines(F.col(text)), lambda lines: let(_blocks(lines), lambda spans: _units(lines, spans, low or 0, high or 0, sorted(sizes), sorted(words))))
    # explode_outer: explode would have the optimizer put the whole expression into a filter too.
    units = df.where(F.col(text).isNotNull()).select(F.col(id).alias("key"), F.explode_outer(found).alias("u")).select("key", "u.*")
    return units.join(hashed, "digest").select(F.col("key").alias(id), "license", "scope", "first_line", "n_lines")


def _blocks(lines: Column) -> Column:
    """ARRAY<STRUCT<a, n, size, word>>: first line, number of lines, characters (joined) and first word of the runs of filled lines."""
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"), F.coalesce(F.get(lines, i - 1), F.lit("")).alias("before"), F.coalesce(F.get(lines, i + 1), F.lit("")).alias("after")))
    starts = F.filter(numbered, lambda s: (s["x"] != "") & (s["before"] == ""))
    ends = F.filter(numbered, lambda s: (s["x"] != "") & (s["after"] == ""))

    def block(a: Column, b: Column) -> Column:
        n = b["i"] - a["i"] + 1
        size = F.length(F.array_join(F.slice(lines, a["i"] + 1, n), " "))
        return F.struct(a["i"].alias("a"), n.alias("n"), size.alias("size"), F.substring_index(a["x"], " ", 1).alias("word"))

    return F.zip_with(starts, ends, block)


def _units(lines: Column, spans: Column, low: int, high: int, sizes: list[int], words: list[str]) -> Column:
    """ARRAY of the document, runs of blocks, its blocks of several lines and its lines, with digests; each entire text once."""

    def unit(scope: str, at: Column, n: Column, body: Column) -> Column:
        return F.struct(F.lit(scope).alias("scope"), at.cast("int").alias("first_line"), n.cast("int").alias("n_lines"), F.sha2(body, 256).alias("digest"))

    none = F.array().cast("array<struct<scope:string,first_line:int,n_lines:int,digest:string>>")
    last = F.element_at(spans, -1)
    first = F.get(spans, F.lit(0))["a"]
    whole = F.array(unit("document", first, last["a"] + last["n"] - first, joined(lines)))
    blocks = F.transform(F.filter(spans, lambda s: s["n"] > 1), lambda s: unit("block", s["a"], s["n"], joined(F.slice(lines, s["a"] + 1, s["n"]))))
    # Runs of blocks: from each block whose first word begins a known text, the following ones while they are not too long.
    most = max(2, high // 2)
    begins = F.filter(F.transform(spans, lambda s, i: F.struct(s["a"].alias("a"), s["word"].alias("word"), i.alias("i"))), lambda s: s["word"].isin(words))

    def from_start(s: Column) -> Column:
        reach = F.slice(spans, s["i"] + 1, most)
        zero = F.struct(F.lit(-1).alias("size"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("ends"))

        def step(acc: Column, x: Column) -> Column:
            size, k = acc["size"] + x["size"] + 1, acc["k"] + 1
            hit = (k > 1) & size.isin(sizes) & (k < F.size(spans))
            return F.struct(size.alias("size"), k.alias("k"), F.when(hit, F.concat(acc["ends"], F.array(x["a"] + x["n"]))).otherwise(acc["ends"]).alias("ends"))

        ends = F.aggregate(reach, zero, step, lambda acc: acc["ends"])
        return F.transform(ends, lambda e: unit("blocks", s["a"], e - s["a"], joined(F.slice(lines, s["a"] + 1, e - s["a"]))))

    runs = F.flatten(F.transform(begins, from_start))
    numbered = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.length(s["x"]).between(low, high))
    single = F.transform(numbered, lambda s: unit("line", s["i"], F.lit(1), s["x"]))
    several = F.size(spans) > 1
    return F.when(F.size(spans) == 0, none).otherwise(F.concat(whole, F.when(several, F.concat(runs, blocks)).otherwise(none), F.when(several | (F.get(spans, F.lit(0))["n"] > 1), single).otherwise(none)))
