"""Licences by the digest of their canonical text.

A text is made canonical (ASCII case, copyright lines, punctuation and equivalent spellings do not count) and
looked up by its SHA-256 among the digests of known licences. A document is looked up as a whole, and so
is each of its lines, since a notice is a line of its own. While the known digests are at most ``MOST_KNOWN``, they go to
every task: the lines of a document are looked up where it is read, whatever it shares with others, and one short row per document is
shuffled. Beyond that both sides are shuffled by digest, where adaptive execution splits a line that very many documents share.

Known by default: the whole texts in the folder ``known`` (Apache-2.0, Artistic-1.0-Perl, CC0-1.0, GFDL-1.3, GPL-2.0 and 3.0, LGPL-2.1 and 3.0,
MPL-1.1 and 2.0), with and without what follows their terms, those in ``KNOWN`` (BSD-2-Clause, BSD-3-Clause, BSL-1.0, ISC, 0BSD, MIT,
MIT-0, Unlicense, Zlib), some notices of a line, and the SPDX lines of all of these. ``scan`` takes any other table.

Defined results: a null or empty text, and one without letters or digits, has no licence. Repeated rows and rows with a
null id each get their own row. Other columns of the input are ignored. An empty table gives no rows; known texts that are empty match nothing.
"""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings that count as one, the first replaced by the second.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("behaviour", "behavior"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"),
    ("customise", "customize"), ("favour", "favor"), ("licence", "license"), ("licenced", "licensed"), ("modelled", "modeled"),
    ("non commercial", "noncommercial"), ("organisation", "organization"), ("organisations", "organizations"), ("programme", "program"),
    ("recognised", "recognized"), ("sub license", "sublicense"), ("utilise", "utilize"), ("whilst", "while"),
)

# Notices and short licences, as published.
KNOWN: Mapping[str, str] = {
    "notice:mit": "Released under the MIT License.",
    "notice:apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice:gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice:cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "notice:reserved": "All rights reserved.",
    "notice:bsd": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "notice:cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "notice:cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "notice:public-domain": "This is free and unencumbered software released into the public domain.",
    "bsd-2-clause": """Copyright (c) <year>, <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "bsd-3-clause": """Copyright (c) <year>, <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "bsl-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and
the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works
of the Software, unless such copies or derivative works are solely in the form of machine-executable object code
generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE
COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    "0bsd": """Copyright (C) <year> by <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.
""",
    "mit-0": """MIT No Attribution

Copyright <YEAR> <COPYRIGHT HOLDER>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    "unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>
""",
    "zlib": """Copyright (c) <year> <owner>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
""",
    "mit": """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    "isc": """Copyright <YEAR> <OWNER>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.
""",
}

#: Known digests that are sent to every task.
MOST_KNOWN = 50_000
# Behind this line follows how to apply the licence, which copies often leave out.
_TERMS_END = "END OF TERMS AND CONDITIONS"

# A line that only says who holds the copyright, maybe behind a comment mark. A line of a licence may begin with the word too, so a sign or a year has to follow.
COPYRIGHT_LINE = r"(?m)^[ \t#;*/!-]*(copyright[ \t]*(\(c\)|©|:|[0-9<\[{]|by[ \t])|\(c\)|©)[^\n]*$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text: lower-case words with one space between them."""
    out = F.regexp_replace(F.translate(text, _UPPER, _LOWER), COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, r"[^a-z0-9\x{80}-\x{10FFFF}\n]+", " ")
    out = F.concat(F.lit(" "), F.replace(out, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.transform(F.split(out, "\n"), lambda x: F.trim(x))


def whole(lines: Column) -> Column:
    """The canonical text of canonical lines, wherever they are broken."""
    out = F.concat(F.lit(" "), F.array_join(F.filter(lines, lambda x: x != ""), " "), F.lit(" "))
    for a, b in SPELLINGS:
        if " " in a:
            out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(out)


def digest(clean: Column) -> Column:
    """SHA-256 of a canonical text, null for one without words."""
    return F.when(clean != "", F.sha2(clean, 256))


def digests(known: DataFrame, license_column: str = "license_id", text: str = "text") -> DataFrame:
    """``(digest, license_id)``, one row per digest: the smallest id of licences with one canonical text."""
    lines = known.select(F.col(license_column).alias("license_id"), canonical_lines(F.col(text)).alias("lines"))
    rows = lines.select("license_id", digest(whole(F.col("lines"))).alias("digest"))
    return rows.filter("digest IS NOT NULL AND license_id IS NOT NULL").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def known_texts() -> list[tuple[str, str]]:
    """``(license_id, text)`` of the licences known by default; one may have several texts."""
    texts = list(KNOWN.items())
    for file in sorted((Path(__file__).parent / "known").glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        texts.append((file.stem, text))
        terms, end, _ = text.partition(_TERMS_END)
        if end:
            texts += [(file.stem, terms), (file.stem, terms + end)]
    names = sorted({name for name, _ in texts if ":" not in name})
    spdx = [(f"notice:{name}", f"SPDX-License-Identifier: {name}") for name in names]
    return texts + [(i, f"{t}{more}") for i, t in spdx for more in ("", "-only", "-or-later") if not more or "gpl" in i or "gfdl" in i]


def known_licenses(spark) -> DataFrame:
    return spark.createDataFrame(known_texts(), "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id_column, digest, license_id, notices)``: of the whole text, and the licences of its lines, sorted."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lines = rows.select("row", "id", canonical_lines(F.col("text")).alias("lines"))
    # The whole text first, then its lines; blank ones are nothing to look up.
    parts = lines.select("row", "id", F.concat(F.array(whole(F.col("lines"))), F.filter("lines", lambda x: x != "")).alias("parts"))
    hashed = parts.select("row", "id", F.posexplode("parts").alias("nth", "part")).select("row", "id", "nth", digest(F.col("part")).alias("digest"))
    listed = digests(known)
    few = listed.limit(MOST_KNOWN + 1).count() <= MOST_KNOWN
    found = hashed.join(F.broadcast(listed) if few else listed, "digest", "left")
    first = F.col("nth") == 0
    return (
        found.groupBy("row", "id")
        .agg(
            F.max(F.when(first, F.col("digest"))).alias("digest"),
            F.max(F.when(first, F.col("license_id"))).alias("license_id"),
            F.array_sort(F.collect_set(F.when(~first, F.col("license_id")))).alias("notices"),
        )
        .select(F.col("id").alias(id_column), "digest", "license_id", "notices")
    )


def license_digest(docs: DataFrame) -> DataFrame:
    found = scan(docs, known_licenses(docs.sparkSession))
    return found.select("doc_id", "digest", "license_id", F.array_join("notices", ",").alias("notices"))


def oracle_sql() -> str:
    """The same in DuckDB."""

    def lines(x: str) -> str:
        out = f"regexp_replace(translate({x}, '{_UPPER}', '{_LOWER}'), '{COPYRIGHT_LINE}', '', 'g')"
        out = rf"regexp_replace({out}, '[^a-z0-9\x{{80}}-\x{{10FFFF}}\n]+', ' ', 'g')"
        out = f"' ' || replace({out}, chr(10), ' ' || chr(10) || ' ') || ' '"
        for a, b in SPELLINGS:
            out = f"replace({out}, ' {a} ', ' {b} ')"
        return f"list_transform(string_split({out}, chr(10)), lambda y: trim(y))"

    def joined(x: str) -> str:
        out = f"' ' || array_to_string(list_filter({x}, lambda y: y <> ''), ' ') || ' '"
        for a, b in SPELLINGS:
            if " " in a:
                out = f"replace({out}, ' {a} ', ' {b} ')"
        return f"trim({out})"

    values = ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in known_texts())
    return f"""
WITH k AS (SELECT min(id) AS license_id, sha256(c) AS digest
  FROM (SELECT id, {joined('l')} AS c FROM (SELECT id, {lines('t')} AS l FROM (VALUES {values}) v(id, t)) x) y WHERE c <> '' GROUP BY c),
p AS (SELECT doc_id, [{joined('l')}] || list_filter(l, lambda y: y <> '') AS parts
  FROM (SELECT doc_id, {lines("coalesce(text, '')")} AS l FROM documents) x),
h AS (SELECT doc_id, nth, CASE WHEN part <> '' THEN sha256(part) END AS digest
  FROM (SELECT doc_id, unnest(parts) AS part, unnest(generate_series(0, len(parts) - 1)) AS nth FROM p) z)
SELECT doc_id, max(CASE WHEN nth = 0 THEN digest END) AS digest, max(CASE WHEN nth = 0 THEN license_id END) AS license_id,
       coalesce(string_agg(DISTINCT CASE WHEN nth > 0 THEN license_id END, ',' ORDER BY CASE WHEN nth > 0 THEN license_id END), '') AS notices
FROM h LEFT JOIN k USING (digest) GROUP BY doc_id
"""
