"""Licence scans by canonical digests, in DataFrame operations only.

A text is brought to a canonical form (letters A-Z lowered, copyright lines dropped, equivalent spellings made one,
everything but letters and digits turned into single spaces) and its SHA-256 looked up by a hash join among the
digests of known licences. A text may also quote a short licence notice as a line of its own; each line is an entire
text too and is looked up alike. Both come from one pass over the text, which keeps line ends until the last step.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that begins so names a holder, not a licence.
COPYRIGHT_LINE = r"(^|\n)[ \t#*/;-]*(copyright|\(c\)|all rights reserved)[^\n]*"
#: Equivalent spellings, on canonical words.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sublicence", "sublicense"), ("organisation", "organization"), ("organisations", "organizations"), ("noninfringement", "non infringement"), ("whilst", "while"), ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"), ("v2", "version 2"), ("v3", "version 3")]

#: Licence texts and notices by their usual identifiers.
KNOWN: dict[str, list[str]] = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3", "SPDX-License-Identifier: GPL-3.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "0BSD": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
}
#: Entire licence texts, each known with and without its title.
TITLED: dict[str, tuple[str, str]] = {
    "BSD-2-Clause": ("BSD 2-Clause License", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    "BSD-3-Clause": ("BSD 3-Clause License", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    "Zlib": ("zlib License", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    "Unlicense": ("The Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>"""),
    "MIT": ("MIT License", KNOWN["MIT"][3]),
    "ISC": ("ISC License", KNOWN["ISC"][0]),
    "0BSD": ("BSD Zero Clause License", KNOWN["0BSD"][0]),
}
KNOWN = {name: [*KNOWN.get(name, []), *([text for title, body in [TITLED[name]] for text in (body, f"{title}\n{body}")] if name in TITLED else [])] for name in {**KNOWN, **TITLED}}
#: Digests of entire texts too long to hold here, whole and up to the end of their terms.
DIGESTS: dict[str, list[str]] = {
    "Apache-2.0": ["ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100", "e9dbf930ca0f1e090ec68da9a37b657d11bc9e43b30643455d6a96dbf73116ca", "1d2490e65bade4b7cde700178105759a1eeb6ed401841c01b9ff35e40e55c5ad"],
    "Artistic-1.0-Perl": ["cc2cd6cccfacd5fb622fb0e9b9a373fa9dcb86a8c152213a2b856dfbe24fe304"],
    "CC0-1.0": ["96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"],
    "GFDL-1.2-only": ["835e93c269f96ffb287b3c8c1c5d41482a48fe84971237b192ae3d0f85299142"],
    "GFDL-1.3-only": ["2d23a1792689607291f114da9fdb3b413c6ef2346dfb9e4fafe0c5cf9b969da3"],
    "GPL-1.0-only": ["8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"],
    "GPL-2.0-only": ["b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1", "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999", "a1e7ba14d8d85807f384435b77f91e925decc43da128311c991c4f2337e44017"],
    "GPL-3.0-only": ["f3ab5ee40da170411ea6671f9845ada2aaba303ee57ba6086b373d1e66c9dc3f", "3dcf77ad8c25248618918aaff1de8a2cb80cea6ca922ef4a7a389cca96a7560b", "3d4de016a08e1d98b27dec755cdf4530b92807d97aaa185b32e12d52942b1943"],
    "LGPL-2.0-only": ["9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3", "ff773d8d898dfc51ae2dbf3baa20700673e8ceb153b13d26c525af34a59adf0c", "e0de5033b5ad2a24c0a1a8b04f09e33038ffa62d2bef7178de2a3c6f5d56f499"],
    "LGPL-2.1-only": ["cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345", "963f79d48038eed98d8341c84d8d3b765e99508a738d00654c0112f70a7c370c", "9bf9c99aeafbdbccd7456a00d574699e3deb41868375496cacbf170be719bebd"],
    "LGPL-3.0-only": ["aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"],
    "MPL-1.1": ["fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"],
    "MPL-2.0": ["95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"],
}
#: Licences that may be looked up; more need a table of their own instead of a broadcast.
MOST_KNOWN = 10_000


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line; Column operations alone."""
    text = F.translate(text, UPPER, LOWER)
    text = F.regexp_replace(text, COPYRIGHT_LINE, "$1")
    text = F.regexp_replace(text, "[^a-z0-9\n\\x{80}-\\x{10FFFF}]+", " ")
    # spaces are doubled and stand around line ends, so that neighbouring words can both be replaced
    text = F.concat(F.lit(" "), F.replace(F.replace(text, F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.transform(F.split(F.regexp_replace(text, " +", " "), "\n"), lambda x: F.trim(x))


def joined(lines: Column) -> Column:
    """The canonical form of an entire text from that of its lines."""
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def canonical_text(text: str) -> str:
    """The same in Python, for the known texts."""
    text = text.translate(str.maketrans(UPPER, LOWER))
    text = re.sub(COPYRIGHT_LINE, r"\1", text)
    text = re.sub("[^a-z0-9\x80-\U0010ffff]+", " ", text).strip(" ")
    text = f" {text.replace(' ', '  ')} "
    for old, new in SPELLINGS:
        text = text.replace(f" {old} ", f" {new} ")
    return re.sub(" +", " ", text).strip(" ")


def known_digests(known: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Digest of each known text, with its licence."""
    digests = {hashlib.sha256(canonical_text(t).encode()).hexdigest(): name for name, texts in (KNOWN if known is None else known).items() for t in texts}
    digests.pop(hashlib.sha256(b"").hexdigest(), None)  # copyright lines alone are no licence
    return digests if known is not None else digests | {digest: name for name, all_ in DIGESTS.items() for digest in all_}


def license_scan(df: DataFrame, identifier: str = "doc_id", text: str = "text", known: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, canonical_sha256, license and notices of every row of df.

    license is the known licence whose text the whole text is, else null. notices are the distinct known licences, in
    order, joined by commas, whose texts are a line of it, else null; a copyright line is none. A null text counts as
    empty and matches nothing, as does one of copyright lines alone. Repeated rows are looked up each; other columns are
    not read. ``known`` replaces the licences that are known by default; more than MOST_KNOWN texts raise.
    """
    digests = known_digests(known)
    if len(digests) > MOST_KNOWN:
        raise ValueError(f"{len(digests)} known texts; {MOST_KNOWN} can be broadcast")
    table = F.broadcast(df.sparkSession.createDataFrame(list(digests.items()), "canonical_sha256 string, license string"))
    # of the lines only those that are as long as a known text are hashed; texts known by digest alone are no single lines
    sizes = sorted({len(canonical_text(t)) for texts in (KNOWN if known is None else known).values() for t in texts} - {0})
    by_digest = F.create_map(*[F.lit(x) for item in digests.items() for x in item]) if digests else F.create_map().cast("map<string,string>")
    lines = F.filter("_lines", lambda x: F.array_contains(F.lit(sizes) if sizes else F.array().cast("array<int>"), F.length(x)))
    names = F.transform(lines, lambda x: F.try_element_at(by_digest, F.sha2(x.cast("binary"), 256)))
    notices = F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull())))
    rows = df.select(F.col(identifier).alias("doc_id"), canonical_lines(F.coalesce(F.col(text), F.lit(""))).alias("_lines"))
    rows = rows.select("doc_id", F.sha2(joined(F.col("_lines")).cast("binary"), 256).alias("canonical_sha256"), F.nullif(F.array_join(notices, ","), F.lit("")).alias("notices"))
    return rows.join(table, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license", "notices")


def oracle(known: dict[str, list[str]] | None = None) -> str:
    """The scan of ``documents`` as DuckDB SQL."""

    def form(x: str) -> str:
        x = f"translate({x}, '{UPPER}', '{LOWER}')"
        x = rf"regexp_replace({x}, '{COPYRIGHT_LINE}', '\1', 'g')"
        x = f"trim(regexp_replace({x}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'), ' ')"
        x = f"(' ' || replace({x}, ' ', '  ') || ' ')"
        for old, new in SPELLINGS:
            x = f"replace({x}, ' {old} ', ' {new} ')"
        return f"sha256(trim(regexp_replace({x}, ' +', ' ', 'g'), ' '))"

    digests = known_digests(known)
    rows = ", ".join(f"('{d}', '{n}')" for d, n in digests.items())
    return f"""WITH known(digest, license) AS (VALUES {rows}),
    texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    whole AS (SELECT r, doc_id, {form("text")} AS canonical_sha256 FROM texts),
    lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts),
    found AS (SELECT DISTINCT r, license FROM (SELECT r, {form("line")} AS digest FROM lines) JOIN known USING (digest)),
    noted AS (SELECT r, string_agg(license, ',' ORDER BY license) AS notices FROM found GROUP BY r)
    SELECT doc_id, canonical_sha256, license, notices FROM whole LEFT JOIN known ON canonical_sha256 = digest LEFT JOIN noted USING (r)"""
