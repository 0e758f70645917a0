"""Licence scans by canonical digest: normalise a whole text, digest it, and join it to the digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that count as the same, after the public matching guidelines for licence texts.
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("copyright holder", "copyright owner"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"),
    ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"),
    ("modelling", "modeling"), ("noncommercial", "non commercial"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("sub license", "sublicense"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"),
)

# Texts of short public licences.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_TAIL = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL3_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", MIT), ("MIT", "The MIT License\n\n" + MIT), ("MIT", "MIT License\n\n" + MIT), ("MIT", "The MIT License (MIT)\n\n" + MIT), ("MIT", "Released under the MIT License."),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_TAIL),
    ("Zlib", ZLIB), ("Unlicense", UNLICENSE), ("Apache-2.0", APACHE_NOTICE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-or-later", GPL3_NOTICE), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
)

#: Further short lines.
LINES: tuple[tuple[str, str], ...] = (("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),)

# Digests of the canonical full texts, whole and up to the end of their terms (without and with that line).
DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "045649cdaf85384ba827242062f2f3b36409835c98d297e25177cb1faf7c2847"),
    ("Apache-2.0", "108490d21e2d3edc9128233e48fabc169818d0c7c5f0bbdd58231a367d2d6c87"),
    ("Apache-2.0", "6ed232a1aaf66db92997c53c056b853f2a64b9f74585489f71cbae1bb4d6d166"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GPL-1.0", "2b62a0899e7031347a9577241eb9b504d0eafb4d91b28e1f99580099701d0a1a"),
    ("GPL-1.0", "fb6d85b04cce9e961a8ac49322a422ceed03720cc44b403f8769a1966d803f0b"),
    ("GPL-1.0", "c4d0d6a72ff991b9d8d8b8de6b66b3ed4e1ace78a8cfb4061b2b63c98deb700b"),
    ("GPL-2.0", "d3d1ea54d09952fcd9626a8c4c7c325e00c7f6febdc41bf004285919d6bfaa0a"),
    ("GPL-2.0", "c2043b33557c653c50c7526295a77726952cb3ecaffc4bfd33a9d0bd36a4fb38"),
    ("GPL-2.0", "ddaa86ecaccd4e34457b7bf4dc7686fa86c10d64951e30e8968efc41b4fba4f1"),
    ("GPL-3.0", "68ca42869e9a3e25843be66c6f296ce2b1f3629ac71d77465db0636dc8781c06"),
    ("GPL-3.0", "df20d6920a2688bef2bb6fb95fc7472aa40799a7027c0ce468190c67658a9656"),
    ("GPL-3.0", "71ebfd10fca4514433d163174bf2f5e27e4829ad059834ac56dae1098f4ebe49"),
    ("LGPL-2.0", "1862ecc2c3c5e3b9e88481e95603c88e089c43e9d5702b2ec01391491b606a9e"),
    ("LGPL-2.0", "e29dcc167f8a363847b3c4b0a7ced67d7a2bb7b9112a3311b6877a9c0570d635"),
    ("LGPL-2.0", "b927da98cda221c8fbc56dfd2b6b2e80f6df686482d12dbac6b79da1ce6bb98a"),
    ("LGPL-2.1", "ac0856eb11aebb30c08445444c942c1ddcde9d0a0447c9ed2b8a19ab7d51eba5"),
    ("LGPL-2.1", "2858f5a00f6672bd47f63b69b9bf4e1bc31f3541b08a5a263e59d9b384f72fdc"),
    ("LGPL-2.1", "2a9689b90bf823adea3df9024818d21d6041c74f3f12ab46ac5ac4d86f654b2e"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "1cfb6cca26abe2169c9c61164807107b2d4a0b64955a2cf2de46fad3483acda1"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
    ("GFDL-1.2", "8446e2329e3fe2b35501056164a645d74fef33dc1b8a2a132629bf1935fa72e7"),
    ("GFDL-1.3", "961b6d8afa12e353079f8676ad28084c800a46123e76f7f4f7e7f81df82289dc"),
    ("Artistic-1.0-Perl", "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a"),
)


def canonical(text: Column) -> Column:
    """Lower case; copyright lines out; runs of anything but letters and digits as one space; one spelling; trimmed.

    A copyright line begins, after signs that are neither letters nor digits, with `(c)` or the sign, or with
    `copyright` and one of these, a digit, a colon, `by` or a bracket (so that a wrapped `copyright holders` is
    none), or it is `all rights reserved` alone. Null stays null.
    """
    t = F.lower(text)
    # lines are looked at only where such a word is in the text at all
    line = r"(?m)^[^\p{L}\p{N}\n]*?(?:copyright\s*(?:\(c\)|©|\d|:|by\b|\[|<)|\(c\)|©)[^\n]*$|(?m)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$"
    bare = F.when(t.contains("copyright") | t.contains("(c)") | t.contains("©") | t.contains("all rights reserved"), F.regexp_replace(t, line, " ")).otherwise(t)
    words = F.concat(F.lit(" "), F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for old, new in SPELLINGS:
        words = F.replace(words, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.btrim(words)


def digests(texts: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep, and digest: sha256 of the canonical text; null for a null text and for one without letters or digits."""
    return texts.select(*keep, canonical(F.col(text)).alias("_canon")).select(*keep, F.sha2(F.nullif("_canon", F.lit("")), 256).alias("digest"))


def known(spark: SparkSession, texts: tuple[tuple[str, str], ...] = KNOWN + LINES, full: tuple[tuple[str, str], ...] = DIGESTS) -> DataFrame:
    rows = digests(spark.createDataFrame(list(texts), "license_id string, text string"), ["license_id"], "text")
    return rows.union(spark.createDataFrame(list(full), "license_id string, digest string")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licences: tuple[tuple[str, str], ...] = KNOWN + LINES) -> DataFrame:
    """doc_id, digest and license_id (null for none) of every row of docs(doc_id, text), which must be a licence as a whole.

    Null texts, and texts without a letter or digit, have no digest and match nothing. Two licences of one digest
    go by the lesser id. Repeated rows each answer; an empty table gives no rows; other columns are not read.
    The known digests are a table fixed in this module, so they are sent to every task.
    """
    light = docs.select("doc_id", F.col("text").alias("_text"))
    of = known(docs.sparkSession, licences).withColumnRenamed("digest", "_of")
    got = digests(light, ["doc_id"], "_text").join(F.broadcast(of), F.col("digest") == F.col("_of"), "left")
    return got.select("doc_id", "digest", "license_id")


def oracle(texts: tuple[tuple[str, str], ...] = KNOWN) -> str:
    """The same as DuckDB SQL, over `texts` alone."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(c: str) -> str:
        out = f"lower({c})"
        line = r"(?:^|\n)[^\p{L}\p{N}\n]*?(?:copyright\s*(?:\(c\)|©|\d|:|by\b|\[|<)|\(c\)|©)[^\n]*|(?:^|\n)[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*(?:$|\n)"
        out = f"regexp_replace({out}, '{line}', chr(10), 'g')"
        out = f"' ' || regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
        for a, b in SPELLINGS:
            out = f"replace({out}, ' {a} ', ' {b} ')"
        return f"sha256(nullif(trim({out}), ''))"

    rows = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in texts)
    return f"""
WITH k(license_id, t) AS (VALUES {rows}),
l AS (SELECT {canon("t")} AS digest, min(license_id) AS license_id FROM k GROUP BY 1),
d AS (SELECT doc_id, {canon("text")} AS digest FROM documents)
SELECT doc_id, digest, license_id FROM d LEFT JOIN l USING (digest)
"""
