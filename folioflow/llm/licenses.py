"""License scans by canonical digests.

A text's canonical form has A-Z lower-cased, copyright lines dropped, every run of ASCII
punctuation and white space (and of common typographic marks) made one space, and then equivalent spellings
made one, so that neither line breaks nor hyphens hide them. A copyright notice ends at its line's end. The form's SHA-256 is looked up among the digests of known licence texts by
a hash join; the known texts are a short fixed list, so they are broadcast. The same lookup
runs over each line of a document as a text of its own, which finds licence notices.

Everything is DataFrame expressions; documents are matched without a shuffle of texts. Null
and empty texts, and texts of punctuation alone, have the digest of the empty form, which
is no licence. Repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import LOWER, UPPER, ascii_lower, table

# Spellings that licence texts use for one another, as they are after punctuation and white space have become one space.
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("behaviour", "behavior"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"),
    ("copyright owner", "copyright holder"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialis", "initializ"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("licence", "license"), ("licencing", "licensing"), ("optimis", "optimiz"), ("organis", "organiz"), ("per cent", "percent"),
    ("programme", "program"), ("realis", "realiz"), ("recognis", "recogniz"), ("utilis", "utiliz"), ("whilst", "while"), ("wilful", "willful"), ("noncommercial", "non commercial"), ("sub licen", "sublicen"), ("https ", "http "),
]
COPYRIGHT = r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|\{|\[|<|[0-9]|by |holders?:)|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*"
MARKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F“”‘’«»–—•·©]+"

# Texts of public licences, and notices that name one.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
KNOWN = [
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT), ("MIT-0", _MIT.split(", subject to")[0] + ".\n\n" + _MIT.split("\n\n")[2]),
    ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC), ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("BSD-2-Clause", _BSD2), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD2),
    ("BSD-3-Clause", _BSD2.replace("\n\nTHIS", "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS")),
    ("Zlib", _ZLIB), ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("CC0-1.0", "Released under CC0 1.0."),
]

# Digests of the canonical forms of whole texts too long to be kept here, each with and without what follows its terms.
KNOWN_DIGESTS = [
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("Apache-2.0", "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "58b6ebdf2bd26f81dd551d8efda909bfbc8914ce77996a5c289c28616b91ceeb"),
    ("GFDL-1.3", "c4f8ea2b5247ab1ff721ce8255137250d4c14f50a0fb68c00fd793f496ced65e"),
    ("GPL-1.0", "0c28ca4dd58dd03edf3afbd7bcf01857c943e8fa9c124d4ca1eaefab216d6b0f"),
    ("GPL-1.0", "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b"),
    ("GPL-1.0", "af30c0af27b90ec812acdb040f3dcc944a87cd893456690efe35063f39e3eeeb"),
    ("GPL-2.0", "9c05d74a883c3b9a1f9c0850cd047eb9d7a3580bdda1f342f19570447984ab29"),
    ("GPL-2.0", "1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca"),
    ("GPL-2.0", "c67cc53030ae25fe2e2f0143b59060eca5ad89da8d2beca1445641234d29fc88"),
    ("GPL-3.0", "dfd1fc3abea1d3d88bd12db363da0b9cdb8731d6e379deb4759ae40fc0208bcb"),
    ("GPL-3.0", "57f71ba95bda9ddb21fcd4d2b6841fdc3ef7fcebd5c12a2fd2ee5f2027869fc6"),
    ("GPL-3.0", "5b8bbbc08610f585b26c4d45ec4c46b3a401532b9362524e72b89d9db72bcb4f"),
    ("LGPL-2.0", "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.1", "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
    ("MPL-2.0", "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de"),
]
#: A larger table of known digests is joined by a shuffle.
BROADCAST_KNOWN = 100_000


def canonical(text):
    """The canonical form of a text."""
    out = F.regexp_replace(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), COPYRIGHT, ""), MARKS, " ")
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def digest(text):
    # never null, and said so: else a join on it computes it once more to filter nulls out
    return F.coalesce(F.sha2(F.encode(canonical(text), "UTF-8"), 256), F.lit(""))


def known_digests(spark, known=None) -> DataFrame:
    """digest, license: one row for each canonical form."""
    rows = spark.createDataFrame(known or KNOWN, "license string, text string").select("license", digest(F.col("text")).alias("digest"))
    if not known:
        rows = rows.union(spark.createDataFrame(KNOWN_DIGESTS, "license string, digest string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest, license of the whole text, and notices: the licences that its lines name; for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = F.broadcast(known) if known.limit(BROADCAST_KNOWN + 1).count() <= BROADCAST_KNOWN else known
    keyed = rows.select("doc_id", F.xxhash64("text").alias("text_key"), digest(F.col("text")).alias("digest"))
    line = rows.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(F.split("text", "\n", -1)).alias("line"))
    line = line.select("doc_id", "text_key", digest(F.col("line")).alias("digest"))
    named = line.join(known, "digest").groupBy("doc_id", "text_key").agg(F.array_join(F.array_sort(F.collect_set("license")), " ").alias("notices"))
    named = named.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "notices")
    out = keyed.join(known, "digest", "left")
    out = out.join(named, out.doc_id.eqNullSafe(named["_id"]) & (out.text_key == named["_key"]), "left")
    return out.select("doc_id", "digest", "license", "notices")


def op1_license_digests(spark, sf_dir: str) -> DataFrame:
    """doc_id, digest, license, notices of all documents."""
    return scan(table(spark, sf_dir, "documents"), known_digests(spark))


def _form(x: str) -> str:
    """SQL of a digest."""
    out = f"regexp_replace(regexp_replace(translate(coalesce({x}, ''), '{UPPER}', '{LOWER}'), '{COPYRIGHT}', '', 'g'), '{MARKS}', ' ', 'g')"
    for a, b in EQUIVALENT:
        out = f"replace({out}, '{a}', '{b}')"
    return f"sha256(trim({out}, ' '))"


def _sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)
    digests = ", ".join(f"('{d}', '{n}')" for n, d in KNOWN_DIGESTS)
    return f"""
with k as (select digest, min(n) as license from (select {_form("t")} as digest, n from (values {quoted}) as v(n, t) union all select * from (values {digests}) as w(d, n)) group by digest),
l as (select distinct doc_id, k.license from (select doc_id, unnest(string_split(text, chr(10))) as l from documents) x join k on k.digest = {_form("l")}),
n as (select doc_id, string_agg(license, ' ' order by license) as notices from l group by 1)
select d.doc_id, {_form("d.text")} as digest, k.license, n.notices from documents d left join k on k.digest = {_form("d.text")} left join n on n.doc_id = d.doc_id
"""


SQL = _sql()
