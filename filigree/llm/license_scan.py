"""License scans by canonical digests, in DataFrame functions alone.

A text is made canonical: lower case; lines that only state a copyright go; equivalent spellings become one; all that is
neither letter nor digit becomes one space, at the ends none. The SHA-256 digest of the whole canonical text is joined with
the digests of known licences and notices, made the same way; of long licences only the digest is kept. A document's whole text is
looked up, and each of its lines as a text of its own, as notices stand alone in a line. A notice of several lines inside a
longer document is not found.

A text can be canonically equal to a known one only if it holds one of MARKS as it stands, whatever its case: each known text
has one of them within a word, and canonical words stand unbroken in the text. That test comes first, so that few texts are
ever rewritten. The known table has a fixed number of rows. No shuffle at all.

Defined cases: a null or empty text matches nothing; a line that repeats is reported each time; a text of one line is
reported as text and as line; rows that repeat are reported each; a null doc_id is reported as such; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

# Known licences and notices.
_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {0} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
_MIT_0 = "\n".join(line for line in _MIT_BODY.split("\n") if not line.startswith("The above")).replace(", subject to the following conditions:", ".")
_0BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <{0}>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BSL = """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
KNOWN = [
    ("MIT", f"MIT License\n{_MIT_BODY}"),
    ("MIT", f"The MIT License (MIT)\n{_MIT_BODY}"),
    ("MIT", _MIT_BODY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("BSD-2-Clause", f"{_BSD_2}\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_2}\n{_BSD_3}\n{_BSD_END}"),
    ("BSD-2-Clause", f"All rights reserved.\n{_BSD_2}\n{_BSD_END}"),
    ("BSD-3-Clause", f"All rights reserved.\n{_BSD_2}\n{_BSD_3}\n{_BSD_END}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD_2}\n{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n{_BSD_2}\n{_BSD_3}\n{_BSD_END}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\nAll rights reserved.\n{_BSD_2}\n{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\nAll rights reserved.\n{_BSD_2}\n{_BSD_3}\n{_BSD_END}"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MIT-0", _MIT_0),
    ("MIT-0", f"MIT No Attribution\n{_MIT_0}"),
    ("0BSD", _0BSD),
    ("0BSD", f"BSD Zero Clause License\n{_0BSD}"),
    ("Unlicense", _UNLICENSE.format("https://unlicense.org")),
    ("Unlicense", _UNLICENSE.format("https://unlicense.org/")),
    ("Zlib", _ZLIB),
    ("Zlib", f"zlib License\n{_ZLIB}"),
    ("BSL-1.0", _BSL),
    ("ISC", f"ISC License\n{_ISC}"),
    ("ISC", _ISC),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-2.0-or-later", _GPL.format(2)),
    ("GPL-3.0-or-later", _GPL.format(3)),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("MPL-2.0", _MPL),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("LicenseRef-public-domain", "This work is in the public domain."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
]
# Digests of the canonical texts of long licences; of the last four, as far as the end of their terms.
DIGESTS = [
    ("Apache-2.0", "e440eb4b067ab3a0604cc274e564c22d407effa41f60ffddd2e80e17f45db876"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("BSD-3-Clause", "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "08978d4dbcdf8773027f972cfd1aba21fe94904fc0194fcf2cf58ee987701793"),
    ("Apache-2.0", "8d7c31f10cecf5237270c0218f1c0200b470f31618e6770309a5ad405adb00b6"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
]
# Spellings that count as one.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sublicence", "sublicense"), ("sublicenced", "sublicensed"), ("sub license", "sublicense"), ("sub licensed", "sublicensed"), ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("merchantibility", "merchantability"), ("organisation", "organization"), ("whilst", "while"), ("wilful", "willful"), ("https", "http"), ("version 2 0", "version 2"), ("v 2 0", "version 2"), ("v2 0", "version 2"), ("version 3 0", "version 3")]
MARKS = ["licen", "permission", "redistribution", "reserved", "domain"]
#: A line that is a statement of copyright and nothing else. It may end in "all rights reserved"; that line by itself stays.
COPYRIGHT = r"(?m)^[^a-z0-9©\n]*(?:copyright|\(c\)|©)[^a-z\n]*(?:\(c\)|©|[0-9])[^\n]*$"


def canonical(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), COPYRIGHT, " ")
    plain = F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")
    plain = F.concat(F.lit(" "), F.trim(plain), F.lit(" "))
    for other, one in SPELLINGS:
        plain = F.replace(plain, F.lit(f" {other} "), F.lit(f" {one} "))
    return F.trim(plain)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession) -> DataFrame:
    values = F.array(*(F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in KNOWN))
    whole = F.array(*(F.struct(F.lit(i).alias("license_id"), F.lit(d).alias("digest")) for i, d in DIGESTS))
    texts = spark.range(1).select(F.explode(values).alias("k")).select("k.license_id", digest(F.col("k.text")).alias("digest"))
    return texts.union(spark.range(1).select(F.explode(whole).alias("k")).select("k.license_id", "k.digest")).distinct()


def scan(docs: DataFrame) -> DataFrame:
    """One row for each match: doc_id, scope ('text' or 'line'), line_no (from 1; 0 for a text), license_id, digest."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    low = F.lower("text")
    marked = docs.where(_marked(low))
    whole = F.array(F.struct(F.lit("text").alias("scope"), F.lit(0).alias("line_no"), F.col("text").alias("part")))
    lines = F.transform(F.split("text", "\n"), lambda x, k: F.struct(F.lit("line").alias("scope"), (k + 1).alias("line_no"), x.alias("part")))
    parts = marked.select("doc_id", F.explode(F.concat(whole, lines)).alias("p")).select("doc_id", "p.scope", "p.line_no", "p.part").where(_marked(F.lower("part")))
    found = parts.withColumn("digest", digest(F.col("part"))).drop("part")
    return found.join(F.broadcast(known(docs.sparkSession)), "digest").select("doc_id", "scope", "line_no", "license_id", "digest")


def _marked(low: Column) -> Column:
    out = F.contains(low, F.lit(MARKS[0]))
    for m in MARKS[1:]:
        out = out | F.contains(low, F.lit(m))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_canonical(x: str) -> str:
    plain = f"regexp_replace(lower({x}), '{COPYRIGHT}', ' ', 'g')"
    plain = f"regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    plain = f"' ' || trim({plain}) || ' '"
    for other, one in SPELLINGS:
        plain = f"replace({plain}, ' {other} ', ' {one} ')"
    return f"trim({plain})"


_VALUES = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
_DIGESTS = ", ".join(f"('{i}', '{d}')" for i, d in DIGESTS)
ORACLE_SQL = f"""
WITH known AS (SELECT DISTINCT license_id, sha256({_sql_canonical('t')}) AS digest FROM (VALUES {_VALUES}) AS v(license_id, t)
  UNION SELECT license_id, digest FROM (VALUES {_DIGESTS}) AS d(license_id, digest)),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
parts AS (
  SELECT doc_id, 'text' AS scope, 0 AS line_no, text AS part FROM documents
  UNION ALL SELECT doc_id, 'line', line_no, part FROM lines),
found AS (SELECT doc_id, scope, CAST(line_no AS INTEGER) AS line_no, sha256({_sql_canonical('part')}) AS digest FROM parts)
SELECT doc_id, scope, line_no, license_id, digest FROM found JOIN known USING (digest)
"""
