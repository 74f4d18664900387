"""Licence scans by canonical digests, in DataFrame and SQL expressions only.

An entire text (a document, or a line of one) is put in canonical form - lower case, copyright notices gone,
equivalent spellings made one, everything but letters and digits one blank - and its SHA-256 is joined to
the digests of known licence texts and notices, which go through the same expression.

Edge cases: null and empty texts have the digest of the empty text, which no licence has. Repeated rows are
scanned one by one. A known text that several licences share is reported under each, the first in the order of
names for the whole text. Null doc_ids keep their rows. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import documents, text_or_empty

#: Canonical form, as (pattern, replacement) applied in this order to the lower-cased text.
#: A line that begins with "copyright" is a notice if a sign, a year or a holder follows, not if the sentence goes on.
CANONICAL = (
    (r"(?m)^[ \t#*/;-]*(?:copyright[ \t:,]*(?:\(c\)|©|[0-9]|(?<=[ \t:,])(?!(?:notices?|holders?|owners?|interests?|licen[sc]es?|laws?)\b)\p{L})|\(c\)|©)[^\n]*$", " "),
    (r"(?m)^[ \t#*/;-]*all rights reserved\.?[ \t]*$", " "),
    (r"licence", "license"),
    (r"sub-license", "sublicense"),
    (r"non-commercial", "noncommercial"),
    (r"copyright[^\p{L}\p{N}]+(?:owner|holder)s?", "copyright holder"),
    (r"\bper cent\b", "percent"),
    (r"https?://(?:www\.)?", ""),
    (r"merchantibility", "merchantability"),
    (r"[^\p{L}\p{N}]+", " "),
)
#: The SQL's own steps: any line that begins with "copyright" goes, and holders are known on one line only.
_SQL_CANONICAL = ((r"(?m)^[ \t#*/;-]*(?:copyright|\(c\)|©)[^\n]*$", " "), *CANONICAL[1:5], (r"copyright (?:owner|holder)s?", "copyright holder"), *CANONICAL[6:])
#: Every known text has one of these, and no step of the canonical form makes one.
MARKS = "licen|permi"

#: Names of licences as notices write them.
NAMES = (
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("EPL-2.0", "Eclipse Public License, version 2.0"),
    ("Unlicense", "Unlicense"),
)
CREATIVE = ("CC0 1.0", "CC BY 4.0", "CC BY-SA 4.0", "CC BY-NC 4.0", "CC BY-ND 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0")
VERBS = ("Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "This project is licensed under", "This software is licensed under", "This program is licensed under", "Distributed under the terms of")

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_AUTHOR = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES '
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_BEFORE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_AFTER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Headers of the GPL family, by licence, name and version.
_GPL = (("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"))


def _gpl_headers() -> list[tuple[str, str]]:
    """The recommended headers, with each of the two ways in which they tell where the licence is to be had."""
    out = []
    for licence, name, version in _GPL:
        what = "library" if licence == "LGPL-2.1" else "program"
        said = f"This {what} is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.\n\nThis {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.\n\nYou should have received a copy of the {name} along with this {what}"
        out += [(licence, said + ". If not, see <https://www.gnu.org/licenses/>."), (licence, said + "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.")]
    return out


#: Short licences in full, without their copyright lines, and the standard headers of long ones.
TEXTS = (
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AUTHOR),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _AUTHOR),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("BSD-2-Clause", _BSD_BEFORE + _BSD_AFTER),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_BEFORE + _BSD_AFTER),
    ("BSD-3-Clause", _BSD_BEFORE + _BSD_THIRD + _BSD_AFTER),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_BEFORE + _BSD_THIRD + _BSD_AFTER),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n" + _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS") + "\n\nFor more information, please refer to <https://unlicense.org>"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *_gpl_headers(),
)


def known_texts() -> list[tuple[str, str]]:
    """(licence, text): the full texts, and notices made of every verb and name."""
    notices = [(licence, f"{verb} {article}{name}.") for verb in VERBS for licence, name in NAMES for article in ("the ", "")]
    notices += [(name.replace(" ", "-"), f"{verb} {article}{name}{tail}.") for verb in VERBS for name in CREATIVE for article in ("", "the ") for tail in ("", " license")]
    return sorted({*TEXTS, *notices})


def canonical(text: Column) -> Column:
    text = F.lower(text)
    for pattern, other in CANONICAL:
        text = F.regexp_replace(text, pattern, other)
    return F.btrim(text)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, licences): one row for each canonical text."""
    table = spark.createDataFrame(known_texts(), "licence string, text string")
    return table.select(digest(F.col("text")).alias("digest"), "licence").groupBy("digest").agg(F.array_sort(F.collect_set("licence")).alias("licences"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, license, n_notices, notices): the licence that the whole text is, and those that lines are. The table of
    known digests, which is of fixed values, is joined to whole texts and looked up for lines: one pass, no shuffle."""
    known = known_digests(docs.sparkSession)
    table = F.create_map(*[F.lit(x) for r in known.collect() for x in (r.digest, "\n".join(r.licences))])  # of fixed values
    marked = lambda x: F.rlike(x, F.lit(f"(?i){MARKS}"))
    names = F.filter(F.transform(F.filter(F.split("text", "\n"), marked), lambda x: F.try_element_at(table, digest(x))), lambda x: x.isNotNull())
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    rows = texts.select("doc_id", digest(F.col("text")).alias("digest"), F.when(marked(F.col("text")), names).otherwise(F.array().cast("array<string>")).alias("found"))
    rows = rows.join(F.broadcast(known), "digest", "left")
    found = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda x: F.split(x, "\n")))))
    return rows.select("doc_id", "digest", F.get("licences", F.lit(0)).alias("license"), F.size("found").cast("long").alias("n_notices"), F.array_join(found, ",").alias("notices"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def oracle_sql() -> str:
    """DuckDB SQL for op6_license_scan."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def clean(text: str) -> str:
        text = f"lower({text})"
        for pattern, other in _SQL_CANONICAL:
            text = f"regexp_replace({text}, {quote(pattern)}, {quote(other)}, 'g')"
        return f"sha256(trim({text}, ' '))"

    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in known_texts())
    return f"""
    WITH known AS (SELECT {clean('t')} AS digest, list_sort(list(DISTINCT l)) AS ls FROM (VALUES {values}) v(l, t) GROUP BY 1),
    line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t FROM documents),
    hit AS (SELECT doc_id, count(*) AS n, list_sort(list_distinct(flatten(list(ls)))) AS found
            FROM (SELECT doc_id, {clean('t')} AS digest FROM line WHERE regexp_matches(t, '(?i){MARKS}')) JOIN known USING (digest) GROUP BY 1),
    whole AS (SELECT doc_id, {clean("coalesce(text, '')")} AS digest FROM documents)
    SELECT w.doc_id, w.digest, k.ls[1] AS license, coalesce(h.n, 0)::BIGINT AS n_notices, coalesce(array_to_string(h.found, ','), '') AS notices
    FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN hit h ON h.doc_id = w.doc_id"""
