"""License scans by canonical digests.

A text becomes canonical: copyright lines gone (whatever marks stand before the word), lower case, every run of other
characters than letters and digits one space, equivalent spellings unified. The SHA-256 of the whole canonical text is
joined to the digests of known licence texts and notices. The same is done to every paragraph (between lines without
letters and digits, so a wrapped notice in a comment is one) and to every line; of these only such are looked at as
hold one of ANCHORS, which every known text does.

Known are the texts and notices in KNOWN, SPDX lines of SPDX, and entire texts by their digests in WHOLE; another
licence, or a text with other words, has no license_id.

Defined results: null counts as empty; an empty canonical text has the digest of "" and no licence; repeated rows
give repeated results.
"""

from __future__ import annotations

import hashlib

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of the BSD texts.
_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_ENDORSE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Licences and their usual notices.
KNOWN = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to "
        "do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "ISC": (
        "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE "
        "AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO "
        "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
        "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "CC0-1.0": ("To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain.",),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "BSD-2-Clause": (_CONDITIONS + _DISCLAIMER,),
    "BSD-3-Clause": (_CONDITIONS + _ENDORSE + _DISCLAIMER, "BSD 3-Clause License " + _CONDITIONS + _ENDORSE + _DISCLAIMER),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not "
        "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
        "the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
        "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Identifiers whose SPDX line is known.
SPDX = ("Apache-2.0", "MIT", "ISC", "Zlib", "Unlicense", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0")
#: SHA-256 of the canonical entire texts as their publishers have them.
WHOLE = {
    "Apache-2.0": "4bc3c949c895ead14c0dc8c6e33fd6ed118359acaad7c084c4d563cd526a878d",
    "Artistic-1.0-Perl": "f273930184a9b8de03336e9ae5d74bef291165524044f55455ee5117f494811a",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71",
    "GFDL-1.3": "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6",
    "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0": "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354",
    "MPL-2.0": "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",
}
#: Equivalent spellings, applied in this order to canonical words.
SPELLINGS = (("licence", "license"), ("non commercial", "noncommercial"), ("sub license", "sublicense"), ("favour", "favor"), ("authorised", "authorized"), ("organisation", "organization"))
#: A copyright line, with the line feed before it: the word with a sign, year, "by" or a name after it, or a sign alone.
COPYRIGHT = r"(^|\n)[^\p{L}\p{N}\n(©]*((copyright|Copyright|COPYRIGHT)[ \t]*([(][cC][)]|©|[0-9]|by |BY )|Copyright[ \t]+\p{Lu}|[(][cC][)]|©)[^\n]*"
#: What parts paragraphs: lines without letters and digits.
BREAK = r"\n([^\p{L}\p{N}\n]*\n)+"
OTHER = r"[^\p{L}\p{N}]+"
#: Every known text holds one of these.
ANCHORS = ("licen", "public domain", "permission", "redistribut")


def canonical(text: Column) -> Column:
    out = F.lower(F.regexp_replace(text, COPYRIGHT, " "))
    out = F.trim(F.regexp_replace(out, OTHER, " "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def canonical_py(text: str) -> str:
    """The same in Python, for the table of digests."""
    out = regex.sub(OTHER, " ", regex.sub(COPYRIGHT, " ", text).lower()).strip(" ")
    for old, new in SPELLINGS:
        out = out.replace(old, new)
    return out


def digests() -> dict[str, str]:
    """SHA-256 of each known canonical text -> licence."""
    known = [(k, t) for k, texts in KNOWN.items() for t in texts] + [(k.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {k}") for k in SPDX]
    return {hashlib.sha256(canonical_py(t).encode()).hexdigest(): k for k, t in known} | {d: k for k, d in WHOLE.items()}


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, canonical_sha256, license_id of the whole text; part_licenses: sorted, comma-joined, of its paragraphs and lines."""
    known = docs.sparkSession.createDataFrame(sorted(digests().items()), "digest string, license_id string")  # a fixed list
    table = F.create_map(*(F.lit(x) for pair in sorted(digests().items()) for x in pair))
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = lambda t: F.sha2(canonical(t).cast("binary"), 256)

    def anchored(line: Column) -> Column:
        low = F.lower(line)
        out = F.lit(False)
        for a in ANCHORS:
            out = out | F.contains(low, F.lit(a))
        return out

    parts = F.filter(F.concat(F.split(text, "\n"), F.split(text, BREAK)), anchored)
    own = F.when(anchored(text), F.array_compact(F.transform(parts, lambda x: F.element_at(table, digest(x))))).otherwise(F.array().cast("array<string>"))
    found = docs.select("doc_id", digest(text).alias("canonical_sha256"), own.alias("_parts"))
    whole = found.join(F.broadcast(known), F.col("canonical_sha256") == F.col("digest"), "left")
    return whole.select("doc_id", "canonical_sha256", "license_id", F.array_join(F.array_sort(F.array_distinct("_parts")), ",").alias("part_licenses"))


def oracle_sql() -> str:
    """The same for DuckDB over `documents`."""

    def canon(x: str) -> str:
        out = f"trim(regexp_replace(lower(regexp_replace({x}, '{COPYRIGHT}', ' ', 'g')), '{OTHER}', ' ', 'g'))"
        for old, new in SPELLINGS:
            out = f"replace({out}, '{old}', '{new}')"
        return f"sha256({out})"

    pairs = sorted(digests().items())
    rows = ", ".join(f"('{d}', '{k}')" for d, k in pairs)
    anchors = " OR ".join(f"contains(lower(x), '{a}')" for a in ANCHORS)
    return f"""
WITH known(digest, license_id) AS (VALUES {rows}),
texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
part_hits AS (
  SELECT DISTINCT l.doc_id, k.license_id
  FROM (SELECT doc_id, {canon("x")} AS digest FROM (SELECT doc_id, unnest(list_concat(string_split(t, chr(10)), string_split_regex(t, '{BREAK}'))) AS x FROM texts) WHERE {anchors}) l
  JOIN known k USING (digest)),
lists AS (SELECT doc_id, string_agg(license_id, ',' ORDER BY license_id) AS part_licenses FROM part_hits GROUP BY doc_id)
SELECT d.doc_id, d.canonical_sha256, k.license_id, coalesce(s.part_licenses, '') AS part_licenses
FROM (SELECT doc_id, {canon("t")} AS canonical_sha256 FROM texts) d
LEFT JOIN known k ON k.digest = d.canonical_sha256
LEFT JOIN lists s ON s.doc_id = d.doc_id
"""
