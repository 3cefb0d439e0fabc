"""Licence scan by canonical digests.

A text and each of its lines are brought to a canonical form: lower case,
lines that only state a copyright left out, every run of other signs than
letters and digits one space, equivalent spellings made one.  The digest of
the whole form is looked up among the digests of known licences and notices.
Only whole forms are compared, so a licence that is merely quoted in a longer
line is not reported.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigfolio.llm.common import cut_lineage, text_of

#: Spellings that licence matching treats as the same word.
EQUIVALENT = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licensor s", "licensors"),
    ("sublicence", "sublicense"), ("sub license", "sublicense"), ("sub licence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("favour", "favor"), ("fulfil", "fulfill"), ("judgement", "judgment"), ("labour", "labor"),
    ("modelling", "modeling"), ("non commercial", "noncommercial"), ("organisation", "organization"),
    ("per cent", "percent"), ("recognised", "recognized"), ("whilst", "while"), ("wilful", "willful"),
    ("https", "http"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
)
#: Words that a line about copyright has, but not one that only states a holder.
SENTENCE = (
    "act|any|are|as|be|been|can|claims?|conditions?|disclaimers?|do|does|for|from|grants?|granted|has|have|hereby|holders?|if|"
    "infringements?|interests?|is|it|its|laws?|licen[sc]\\w*|may|must|not|notices?|or|our|owners?|ownership|patents?|permission|"
    "protected|protection|rights?(?! reserved)|shall|statements?|terms?|that|these|this|those|to|trademarks?|treat(?:y|ies)|under|"
    "was|we|were|which|will|with|you|your")
#: How a line may begin before its first word.
BEGINS = r"^[ \t*#/;-]*"
MARK = r"(?:copyright|©|\(c\))"
#: Words that go on with a sentence about copyright.
GOES_ON = r"(?:and|in|of|on|at)\b"
#: A line that only states a copyright: marks and a year, two marks, or a mark and what may be a holder; of a line that
#: begins with "all rights reserved" only these words go.  Every loop is possessive: none backtracks or recurses.
COPYRIGHT_LINE = (
    r"(?dm)" + BEGINS + r"+(?:all rights reserved[.]?[ \t]*+|(?:(?:" + MARK + r"[ \t]*+)++(?:[0-9]{4}|<|\[)|" + MARK + r"[ \t]*+(?:\(c\)|©)"
    r"|(?:\(c\)[ \t]*+)?+(?:copyright|©)(?![a-z])(?=[^\n]*[\p{L}\p{N}])[ \t:,]*+(?:by )?+(?!" + GOES_ON + r")(?![^\n]*\b(?:" + SENTENCE + r")\b))[^\n]*+)")
#: Signs between words; line ends stay.
OTHER_SIGNS = r"[^\p{L}\p{N}\n]+"

#: Licence texts without their copyright line.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly
marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any
source distribution."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: {}Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. {}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT
{} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {} BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_3 = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. """
PROVIDERS = ("HOLDERS AND CONTRIBUTORS", "HOLDER AND CONTRIBUTORS")
LIABLE = ("HOLDER OR CONTRIBUTORS", "HOLDERS OR CONTRIBUTORS")
BSD_2_TEXTS = tuple(BSD.format(a, b, "", x, y) for a, b in (("1. ", "2. "), ("* ", "* ")) for x in PROVIDERS for y in LIABLE)
BSD_3_TEXTS = tuple(BSD.format(a, b, c + BSD_3, x, y) for a, b, c in (("1. ", "2. ", "3. "), ("* ", "* ", "* ")) for x in PROVIDERS for y in LIABLE)
ZERO_BSD = ISC.replace(""",
provided that the above copyright notice and this permission notice appear in all copies.""", ".")
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any
and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present
and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
UNLICENSE_MORE = "For more information, please refer to <http://unlicense.org{}>"
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this {} except in compliance with the License. You
may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License."""
TEXTS = {
    "MIT": (MIT,), "ISC": (ISC, ISC.replace("and/or distribute", "and distribute")), "Zlib": (ZLIB,), "BSD-2-Clause": BSD_2_TEXTS, "BSD-3-Clause": BSD_3_TEXTS, "0BSD": (ZERO_BSD,),
    "Unlicense": (UNLICENSE, *(f"{UNLICENSE}\n{UNLICENSE_MORE.format(x)}" for x in ("", "/"))),
    "Apache-2.0": tuple(APACHE.format(x) for x in ("file", "software", "work")),
}
HEADS = {
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"), "Unlicense": ("The Unlicense",), "Apache-2.0": (),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"), "Zlib": ("zlib License", "The zlib License")}

#: Names that notices use.
NAMES = {
    "MIT": ("the MIT License", "MIT"), "ISC": ("the ISC License",), "Zlib": ("the zlib License",),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License",), "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License"),
    "GPL-2.0": ("the GNU General Public License, version 2", "GPL-2.0"), "GPL-3.0": ("the GNU General Public License, version 3", "GPL-3.0"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3",), "AGPL-3.0": ("the GNU Affero General Public License, version 3",),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"), "CC0-1.0": ("CC0 1.0",),
    "CC-BY-4.0": ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0",), "CC-BY-NC-4.0": ("CC BY-NC 4.0",), "CC-BY-ND-4.0": ("CC BY-ND 4.0",),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",), "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",),
}
NOTICES = ("Licensed under {}", "Released under {}", "Distributed under {}", "Available under {}", "This work is licensed under {}",
           "This software is licensed under {}", "This project is licensed under {}", "SPDX-License-Identifier: {}")
#: Digests of the canonical forms of long whole texts, as Debian's common-licenses and package files hold them.
DIGESTS = {
    "Apache-2.0": ("036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b",   # with the appendix
                   "6074c3536c43b739207170b87d1681477d0f07374ed3d862ba461334cce848e3",   # its copyright line named otherwise
                   "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe",   # up to "END OF TERMS AND CONDITIONS"
                   "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64"),  # without that line
    "CC0-1.0": ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",),
    "GPL-1.0": ("8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",),
    "GPL-2.0": ("efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",),
    "GPL-3.0": ("eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
                "9faf4f9b13ca844eeee37346a77dec74f558096ac2b418782a99c8afe4c772da"),
    "LGPL-2.0": ("61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",),
    "LGPL-2.1": ("4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
                 "5db6a0cf025514ea4a904dd0c2731b3a48aec5259d5f1ec782685806040d7b6a"),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-1.1": ("a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b",),
    "MPL-2.0": ("f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
                "acb0bece3dc447740b87a4db23e0d425157552e4a33f273241a94444c2368900"),  # the header of source files
}


def known_texts(whole: dict[str, tuple[str, ...]] = TEXTS) -> list[tuple[str, str]]:
    """(licence, whole text) of the licences and notices known here."""
    out = [(k, f"{head}\n{body}") for k, bodies in whole.items() for body in bodies for head in ("", *HEADS[k])]
    out += [(k, notice.format(name)) for k, names in NAMES.items() for name, notice in product(names, NOTICES)]
    return out + [(k, f"SPDX-License-Identifier: {k}") for k in NAMES]


def _spelled(form: Column, pairs) -> Column:
    for one, other in pairs:
        form = F.replace(form, F.lit(_apart(one)), F.lit(_apart(other)))
    return form


def _apart(words: str) -> str:
    """Words with a space on each side of every one, as forms have them while
    spellings are replaced: neighbours share no space."""
    return "".join(f" {w} " for w in words.split())


def _together(form: Column) -> Column:
    return F.trim(F.regexp_replace(form, " +", " "))


def line_forms(text: Column) -> Column:
    """A whole text's words with canonical spellings and line ends, ``\\n``
    standing where the text has one: what whole form and line forms share."""
    words = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), OTHER_SIGNS, "  ")
    marked = F.concat(F.lit("  "), F.replace(words, F.lit("\n"), F.lit("  \n  ")), F.lit("  "))
    return _spelled(marked, EQUIVALENT)


def whole_form(lines: Column) -> Column:
    """The whole text's canonical form; spellings of several words may span lines."""
    return _together(_spelled(F.regexp_replace(lines, " *\n *", "  "), [p for p in EQUIVALENT if " " in p[0]]))


def canonical(text: Column) -> Column:
    """The canonical form of a whole text."""
    return whole_form(line_forms(text))


def digest_of(form: Column) -> Column:
    """NULL for a form without words."""
    return F.when(form != "", F.sha2(form, 256))


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] | None = None, more: DataFrame | None = None) -> DataFrame:
    """(known, license): digests of known texts; the smallest licence name
    stands where texts of several have the same form.  ``texts`` replaces the
    ones known here, ``more`` is a table (license, text) of further ones."""
    rows = spark.createDataFrame(known_texts() if texts is None else texts, "license string, text string")
    if more is not None:
        rows = rows.unionByName(more.select("license", "text"))
    known = rows.select(digest_of(canonical(F.col("text"))).alias("known"), "license").filter("known IS NOT NULL")
    if texts is None:
        known = known.unionByName(spark.createDataFrame([(x, k) for k, xs in DIGESTS.items() for x in xs], "known string, license string"))
    return known.groupBy("known").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, digest of the whole text's canonical form (NULL if it
    has no words), license (of the whole text, else NULL), n_license_lines
    and line_licenses (of the lines of that doc_id, sorted, joined by commas;
    empty if none).

    NULL and empty texts have no digest; repeated rows and NULL ids give a
    row each, and rows of one doc_id share their lines; other columns take no
    part; an empty table gives no rows, no known licences give no finds.  A
    text or line of any length is handled whole, in time that grows with it.

    Each text is brought to its forms once; what goes on is a written table
    of digests.
    """
    forms = docs.select(F.col(id_col).alias("doc_id"), line_forms(text_of(text_col)).alias("lines"))
    digests = cut_lineage(forms.select("doc_id", digest_of(whole_form(F.col("lines"))).alias("digest"), _line_digests("lines").alias("lines")),
                          "license-digests")
    lines = digests.select(F.col("doc_id").alias("line_of"), F.explode("lines").alias("line"))
    lines = (lines.join(known.select(F.unhex("known").alias("line"), "license"), "line")
             .groupBy("line_of", "license").agg(F.count(F.lit(1)).alias("n"))  # at most a row per known licence
             .groupBy("line_of").agg(F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_list("license")), ",").alias("names")))
    rows = digests.select("doc_id", "digest")
    found = rows.join(known, rows["digest"] == known["known"], "left").select("doc_id", "digest", "license")
    return (found.join(lines, found["doc_id"].eqNullSafe(lines["line_of"]), "left")
            .select("doc_id", "digest", "license", F.coalesce("n", F.lit(0)).alias("n_license_lines"), F.coalesce("names", F.lit("")).alias("line_licenses")))


def _line_digests(lines: str) -> Column:
    """Digests of the forms of a text's lines, without lines that have no words."""
    parts = F.transform(F.split(_together(F.col(lines)), " ?\n ?"), lambda x: F.trim(x))
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.unhex(F.sha2(x, 256)))


# ----------------------------------------------------------------- SQL

def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def duckdb_form(text: str) -> str:
    """The canonical form of a text expression as DuckDB SQL: line by line,
    by conditions of its own, since its patterns look neither ahead nor back."""
    def has(value: str, pattern: str) -> str:
        return f"regexp_matches({value}, {_quote(pattern)}, 's')"

    def without(value: str, pattern: str, put: str = "", how: str = "s") -> str:
        return f"regexp_replace({value}, {_quote(pattern)}, {_quote(put)}, {_quote(how)})"

    holder = BEGINS + r"(?:\(c\)[ \t]*)?(?:copyright|©)"
    after = f"regexp_extract(x, {_quote(holder + '(.*)$')}, 1, 's')"
    told = without(after, "^[ \\t:,]*(by )?")
    # the one look ahead of these words: "rights" says nothing where "reserved" follows
    words = r"\b(?:" + SENTENCE.replace("(?! reserved)", "") + r")\b"
    states = " OR ".join((
        has("x", BEGINS + "(?:" + MARK + r"[ \t]*)+([0-9]{4}|<|\[)"), has("x", BEGINS + MARK + r"[ \t]*(\(c\)|©)"),
        f"({has('x', holder)} AND NOT {has(after, '^[a-z]')} AND {has(after, '[\\p{L}\\p{N}]')} AND NOT {has(told, '^' + GOES_ON)} "
        f"AND NOT {has(without(told, '\\brights? reserved', ' ', 'g'), words)})"))
    rest = without("x", BEGINS + r"all rights reserved[.]?[ \t]*")
    kept = f"list_transform(string_split(lower({text}), chr(10)), lambda x: CASE WHEN {states} THEN '' ELSE {rest} END)"
    form = f"'  ' || {without(f'array_to_string({kept}, chr(10))', r'[^\p{L}\p{N}]+', '  ', 'g')} || '  '"
    for one, other in EQUIVALENT:
        form = f"replace({form}, {_quote(_apart(one))}, {_quote(_apart(other))})"
    return f"trim({without(form, ' +', ' ', 'g')})"


def duckdb_known() -> str:
    """Rows (license, text) of the known texts as DuckDB SQL."""
    return "VALUES " + ", ".join(f"({_quote(k)}, {_quote(t)})" for k, t in known_texts())


def duckdb_digests() -> str:
    """Rows (license, known) of the texts known by their digests."""
    return "VALUES " + ", ".join(f"({_quote(k)}, {_quote(x)})" for k, xs in DIGESTS.items() for x in xs)
