"""License scans by canonical digest: whole texts that are a known licence.

A text is brought to a canonical form: A-Z lower-cased, lines of copyright and reserved rights dropped, everything but ASCII letters, digits and
non-ASCII characters turned into single blanks, equivalent spellings made one. The SHA-256 of this form is joined with the
digests of the known licences, which get the same treatment, so differences in case, punctuation, line breaks, holders and
years do not matter and any other difference does.

The known licences are short ones by their texts, alone and under their usual titles, and long ones by the digests of their
canonical forms, whole and without the appendix on how to apply them.

Defined cases: very long texts are digested as a whole; null and empty texts have the digest of the empty string, which is no licence's; null ids and repeated rows stay
rows; of known texts with one digest the least name counts; other columns are ignored; an empty table gives no rows. The known
digests are a list of the program's, KNOWN_LIMIT at most, and therefore broadcast; a longer table can be given as a DataFrame,
which is joined as Spark sees fit.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KNOWN_LIMIT = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT = r"(^|\n)[ \t*#/]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
OTHERS = r"[^0-9a-z\x80-\x{10FFFF}]+"

# --- fixed values -------------------------------------------------------------------------------------------------
#: Equivalent spellings, words by words, in the order in which they are replaced.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("organisation", "organization"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"),
    ("favour", "favor"), ("whilst", "while"), ("wilful", "willful"), ("http", "https"),
)
#: Licences and their texts.
LICENSES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "WTFPL": """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.
DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
}
#: The clause that BSD-3-Clause has more than BSD-2-Clause, before the disclaimer.
ENDORSEMENT = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
LICENSES["BSD-3-Clause"] = LICENSES["BSD-2-Clause"].replace("THIS SOFTWARE IS PROVIDED BY", ENDORSEMENT + "THIS SOFTWARE IS PROVIDED BY")
#: Usual titles, as a line before the text.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License'), "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "Zlib": ("zlib License", "The zlib License"), "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",), "Unlicense": ("The Unlicense",), "WTFPL": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004",),
}
#: Digests of the canonical forms of long licences, as their publishers' texts have them.
DIGESTS = {
    "Apache-2.0": ("bb9b9809799dde483dd255c759a87cd240b7c00fdd56de34e1e2af5eba9be6f7", "4a2113efebb26d73cd2aaaeeb5e145a2eb6823625a041b5597daaf97b8b0f36d",),
    "Artistic-1.0-Perl": ("66e644aafc5ff1de25be918be7e71d1d851bab015f750bc67c5b245e5f33ff39",),
    "CC0-1.0": ("cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",),
    "GFDL-1.2": ("f06741c6c5feec30d99f80228f0d9ea6b884eae0e790ab18a0f4257184befa86",),
    "GFDL-1.3": ("80229e90e6f40a551a447f33ef48bd361a8e3166d53f29a2d1537245e2064feb",),
    "GPL-1.0": ("8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",),
    "GPL-2.0": ("b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1", "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999",),
    "GPL-3.0": ("f3ab5ee40da170411ea6671f9845ada2aaba303ee57ba6086b373d1e66c9dc3f", "3dcf77ad8c25248618918aaff1de8a2cb80cea6ca922ef4a7a389cca96a7560b",),
    "LGPL-2.0": ("9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3", "ff773d8d898dfc51ae2dbf3baa20700673e8ceb153b13d26c525af34a59adf0c",),
    "LGPL-2.1": ("cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345", "963f79d48038eed98d8341c84d8d3b765e99508a738d00654c0112f70a7c370c",),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-1.1": ("fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354",),
    "MPL-2.0": ("3dacd2c104719e7227969cbdcc7d581518827199e830b9379627eec0a32f8ab7",),
}
# ------------------------------------------------------------------------------------------------------------------


def canonical(text: str) -> str:
    """The canonical form, as ``canonical_column`` computes it."""
    x = re.sub(COPYRIGHT, "\n", text.translate(str.maketrans(UPPER, LOWER)))
    x = " " + re.sub("[^0-9a-z\x80-\U0010ffff]+", "  ", x) + " "
    for a, b in _spaced():
        x = x.replace(a, b)
    return x.replace("  ", " ").strip(" ")


def _spaced() -> list[tuple[str, str]]:
    """The spellings between blanks: words are two blanks apart meanwhile, so that neighbours don't share one."""
    return [tuple(f" {x.replace(' ', '  ')} " for x in pair) for pair in SPELLINGS]


def canonical_column(text: Column) -> Column:
    x = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), COPYRIGHT, "\n")
    x = F.concat(F.lit(" "), F.regexp_replace(x, OTHERS, "  "), F.lit(" "))
    for a, b in _spaced():
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.replace(x, F.lit("  "), F.lit(" ")))


def digest_column(text: Column) -> Column:
    return F.sha2(canonical_column(text).cast("binary"), 256)


def digest(text: str) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


def known(licenses: dict[str, str] | None = None) -> dict[str, str]:
    """Digest to name, of the given texts or else of all known licences."""
    found = [(name, digest(text)) for name, text in (LICENSES if licenses is None else licenses).items()]
    if licenses is None:
        found += [(name, digest(f"{title}\n{LICENSES[name]}")) for name, titles in TITLES.items() for title in titles]
        found += [(name, d) for name, digests in DIGESTS.items() for d in digests]
    if len(found) > KNOWN_LIMIT:
        raise ValueError(f"{len(found)} licences; give them as a DataFrame")
    out: dict[str, str] = {}
    for name, d in sorted(found):
        out.setdefault(d, name)
    return out


def scanned(docs: DataFrame, digests: DataFrame | None = None, licenses: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, text_sha256, license): the canonical digest, and the licence or null. digests: (digest, license) instead of a list."""
    rows = docs.select("doc_id", digest_column(F.col("text")).alias("text_sha256"))
    if digests is None:
        pairs = F.array(*[F.struct(F.lit(d).alias("digest"), F.lit(n).alias("license")) for d, n in known(licenses).items()])
        digests = F.broadcast(docs.sparkSession.range(1).select(F.explode(pairs).alias("p")).select("p.digest", "p.license"))
    else:
        digests = digests.groupBy("digest").agg(F.min("license").alias("license"))
    return rows.join(digests, rows["text_sha256"] == digests["digest"], "left").select("doc_id", "text_sha256", "license")


def query(docs: DataFrame) -> DataFrame:
    return scanned(docs)


def oracle() -> str:
    x = rf"regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{COPYRIGHT}', chr(10), 'g')"
    x = f"' ' || regexp_replace({x}, '{OTHERS}', '  ', 'g') || ' '"
    for a, b in _spaced():
        x = f"replace({x}, '{a}', '{b}')"
    x = f"replace({x}, '  ', ' ')"
    values = ", ".join(f"('{d}', '{n}')" for d, n in known().items())
    return f"""
WITH d AS (SELECT doc_id, sha256(trim({x}, ' ')) AS text_sha256 FROM documents)
SELECT doc_id, text_sha256, license FROM d LEFT JOIN (VALUES {values}) AS k(digest, license) ON text_sha256 = digest
"""
