"""Licence scans by canonical digest.

A text is brought to a canonical form (lower case, copyright lines dropped, equivalent
spellings united, everything but letters and digits turned to single spaces) and its
SHA-256 is hash-joined to the digests of known licences. Units are the entire text and
each of its lines, so that one-line notices inside a document are found too.

Units are brought to canonical form only where their first word may be that of a known
licence, and are digested and travel only where their canonical length may be that of one;
both are looked up in bitmaps of fixed size, which lose none. Known licences are a
parameter: texts, or digests with length and first word as DIGESTS has them for texts that
are too long to be kept here.

Edge cases: null and empty texts match nothing; a text that is a licence as a whole and
by a line is reported for both units; repeated rows are reported alike; known licences of
equal canonical form are all reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the bitmaps of first words and of lengths.
BITS = 1 << 14
COPYRIGHT = r"(?m)^[ \t]*(?:copyright\b|\(c\)|©|all rights reserved).*$"
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("organisation", "organization"), ("favour", "favor"), ("whilst", "while"), ("merchantibility", "merchantability"), ("per cent", "percent"), ("https://", "http://"), ("&", " and "), ("version 2[.]0", "version 2"), ("version 3[.]0", "version 3")]

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_3 = BSD_2 + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
KNOWN = [
    *[(name, head + body + BSD_DISCLAIMER) for name, body in (("BSD-2-Clause", BSD_2), ("BSD-3-Clause", BSD_3)) for head in ("", f"{name[:3]} {name[4]}-Clause License\n\n")],
    ("MIT", MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("Zlib", ZLIB),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
]

#: Texts of the public licences as they are handed out, by the digest of their canonical form: licence, digest, length and first word.
DIGESTS: list[tuple[str, str, int, str]] = [
    ("Apache-2.0", "d49c70a96104d52f89cc0d81024f9ed2483e01688ddd0b7bd4decb4b08c647ad", 8682, "apache"),
    ("Apache-2.0", "d35894668a0cfa5c2613ef8629bd82652ebe3c5e844d895f0a70de6d92526893", 9696, "apache"),
    ("Artistic-1.0-Perl", "7684e7ab2b843b2ea93db77f1db7f373c6a2c3be0cb5c87cb97f1c1752ab1cf4", 5710, "the"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651", 1361, "redistribution"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", 6692, "creative"),
    ("GFDL-1.2", "37db86be8f16e9b8dfb0d63e1698ad2e07d54f312494c1cb2dbdb4fa37487f0f", 19514, "gnu"),
    ("GFDL-1.3", "7befa86e5ee53162018d597eee81db6c727f3e64fab4641af93e19deab1807b4", 21882, "gnu"),
    ("GPL-1.0", "7843068060f4d9ee30736221ce49abf6cb7dafa9b775fabb47fbf0c21e05b102", 9424, "gnu"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", 11765, "gnu"),
    ("GPL-2.0", "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999", 14419, "gnu"),
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1", 17053, "gnu"),
    ("GPL-3.0", "3dcf77ad8c25248618918aaff1de8a2cb80cea6ca922ef4a7a389cca96a7560b", 30836, "gnu"),
    ("GPL-3.0", "010ce52b3b970c80b5447205f4afc3b42084811cda2d11b95178b1fd3940764f", 33274, "gnu"),
    ("LGPL-2.0", "a07313094d4e63b099417491ebc80c933bf85c36d5afddbf13be9a11457c8513", 22146, "gnu"),
    ("LGPL-2.0", "e2c319279ddf282349927826fd110bdb5b471edc3a726a66fe333c8184a4b135", 23999, "gnu"),
    ("LGPL-2.1", "bfe8e5dc6cef43d0c4777d9c1891f596159cda682ef40545ad2105f66b9746f1", 23234, "gnu"),
    ("LGPL-2.1", "13cd11e9ccd3aae212d64d9b0f62b3a67f21019c6a65212e582b2cbbeb91cb70", 25086, "gnu"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 7104, "gnu"),
    ("MPL-1.1", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6", 22339, "mozilla"),
    ("MPL-2.0", "4e8846f73619955307f302e00350d36240da6319b9a40e68e67486570e5a137e", 14265, "mozilla"),
]


def canonical(text: str) -> str:
    """The SQL expression of a text's canonical form."""
    x = f"regexp_replace(lower({text}), {quoted(COPYRIGHT)}, '')"
    for old, new in SPELLINGS:
        x = f"regexp_replace({x}, {quoted(old)}, {quoted(new)})"
    return f"trim(regexp_replace({x}, '[^0-9a-zà-öø-ÿ]+', ' '))"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def known(spark: SparkSession) -> DataFrame:
    """The built-in list: licence and text, or digest, length and first word."""
    rows = [(n, t, None, None, None) for n, t in KNOWN] + [(n, None, *d) for n, *d in DIGESTS]
    return spark.createDataFrame(rows, "licence string, text string, digest string, length int, word string")


def first_word(text: str) -> str:
    """The SQL expression of the first word of a text's canonical form; empty where it isn't among the first characters."""
    x = f"lower(substr({text}, 1, 2000))"
    for old, new in SPELLINGS:
        if "[" not in old:  # patterns with a bracket leave first words alone
            x = f"replace({x}, {quoted(old)}, {quoted(new)})"
    dropped = COPYRIGHT.removeprefix("(?m)").replace(".*$", "[^\n]*")
    return f"regexp_extract({x}, {quoted(f'(?m)^(?:{dropped}|[^0-9a-zà-öø-ÿ])*+([0-9a-zà-öø-ÿ]*)')}, 1)"


def digests(licences: DataFrame) -> DataFrame:
    """licence, digest, length and first word of each known licence."""
    made = licences.withColumn("_c", F.expr(canonical("text")))
    own = {"digest": F.sha2("_c", 256), "length": F.length("_c"), "word": F.substring_index("_c", " ", 1)}
    made = made.select("licence", *[(F.when(F.col("_c") != "", c) if n not in licences.columns else F.coalesce(F.when(F.col("_c") != "", c), n)).alias(n) for n, c in own.items()])
    return made.where("digest IS NOT NULL").distinct()


def bitmap(values: DataFrame) -> str:
    """A literal array of longs with the bits of a column of numbers: BITS of them, whatever the size of the table."""
    bits = values.select(F.pmod(F.col(values.columns[0]), F.lit(BITS)).cast("int").alias("b"))
    words = {r.w: r.x for r in bits.groupBy(F.expr("b div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, b % 64))").alias("x")).collect()}
    return f"array({', '.join(f'{words.get(k, 0)}L' if words.get(k, 0) != -(1 << 63) else 'cast(-9223372036854775808 as bigint)' for k in range(BITS // 64))})"


def within(bits: str, number: str) -> str:
    return f"((shiftright(element_at({bits}, cast(pmod({number}, {BITS}) div 64 as int) + 1), cast(pmod({number}, {BITS}) % 64 as int)) & 1) = 1)"


def scan(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """doc_id, unit ('text' or 'line'), digest and licence, with the number of such units of the document."""
    wanted = digests(licences)
    words, lengths = bitmap(wanted.select(F.xxhash64("word"))), bitmap(wanted.select("length"))
    all_units = "concat(array(struct('text' as unit, text as t)), case when instr(text, '\n') > 0 then transform(split(text, '\n'), l -> struct('line' as unit, l as t)) else array() end)"
    maybe = f"{within(words, 'xxhash64(w)')} or (w = '' and length(u.t) > 2000)"
    opens = f"filter({all_units}, u -> exists(array({first_word('u.t')}), w -> {maybe}))"
    fitting = f"filter(transform({opens}, u -> struct(u.unit as unit, {canonical('u.t')} as c)), u -> u.c <> '' and {within(lengths, 'length(u.c)')})"
    units = docs.where("text IS NOT NULL").select("doc_id", F.explode(F.expr(fitting)).alias("u"))
    found = units.select("doc_id", "u.unit", F.sha2("u.c", 256).alias("digest"))
    return found.join(wanted.select("digest", "licence").distinct(), "digest").groupBy("doc_id", "unit", "licence", "digest").agg(F.count(F.lit(1)).alias("n_units"))


def sql(table: str = "documents") -> str:
    """The same in DuckDB's SQL over the built-in list."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    form = lambda x: _duck(x, q)
    rows = ", ".join(f"({q(n)}, {q(t)})" for n, t in KNOWN)
    long = ", ".join(f"({q(n)}, {q(d)})" for n, d, *_ in DIGESTS)
    return (
        f"WITH k AS (SELECT DISTINCT licence, sha256({form('t')}) AS digest FROM (VALUES {rows}) v(licence, t) UNION SELECT * FROM (VALUES {long}) w(licence, digest)), "
        f"u AS (SELECT doc_id, 'text' AS unit, text AS t FROM {table} UNION ALL SELECT doc_id, 'line', unnest(string_split(text, chr(10))) FROM {table} WHERE contains(text, chr(10))), "
        f"d AS (SELECT doc_id, unit, sha256({form('t')}) AS digest FROM u WHERE t IS NOT NULL AND {form('t')} <> '') "
        "SELECT doc_id, unit, licence, d.digest, count(*) AS n_units FROM d JOIN k ON d.digest = k.digest GROUP BY doc_id, unit, licence, d.digest"
    )


def _duck(x: str, q) -> str:
    x = f"regexp_replace(lower({x}), {q(COPYRIGHT)}, '', 'g')"
    for old, new in SPELLINGS:
        x = f"regexp_replace({x}, {q(old)}, {q(new)}, 'g')"
    return f"trim(regexp_replace({x}, '[^0-9a-zà-öø-ÿ]+', ' ', 'g'))"
