"""Licence scan: canonical digest look-up of entire texts.

A text is made canonical: case, accents of no meaning to a licence, punctuation, white space,
lines that only state a copyright, and equivalent spellings no longer matter. The digest of the
result is joined by hash with the digests of known licence texts and notices. What is looked up
is a whole document, and each of its lines and paragraphs as a text of its own, so notices
inside other text are found; nothing is matched in part or by similarity.

Known texts come as a table (licence, text). The one given here holds the full texts in the
folder ``licence_texts`` (named by SPDX id) bare and below their usual titles, the short public
notices of ``KNOWN``, and an SPDX line for each of ``SPDX_IDS``. Texts that hold none of
``MARKS`` are left out early if every known text holds one. The known digests are counted and broadcast only below a checked bound; beyond it the
units' digests (not their texts) are shuffled.

Null, empty and wordless texts have no digest and match nothing. Repeated documents each get
their rows. Equal paragraphs of a document count once each.
"""

from __future__ import annotations

import string
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.llm.common import counted, saved, small

#: Public licence notices, as licence and text.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
     "except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
     "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
     "for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
     "copy of the MPL was not distributed with this file, You can obtain one at "
     "http://mozilla.org/MPL/2.0/."),
    ("ISC",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
     "without fee is hereby granted, provided that the above copyright notice and this "
     "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
     "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
     "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
     "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
     "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
     "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
]

#: Licences that a line "SPDX-License-Identifier: ..." names.
SPDX_IDS = """
    0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0
    BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1
    CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0
    CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FTL GFDL-1.2-only
    GFDL-1.2-or-later GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0+ GPL-2.0-only
    GPL-2.0-or-later GPL-3.0 GPL-3.0+ GPL-3.0-only GPL-3.0-or-later HPND ICU ISC LGPL-2.0-only LGPL-2.0-or-later
    LGPL-2.1 LGPL-2.1+ LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0+ LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c
    MIT MIT-0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-2.0 NCSA NIST-PD ODbL-1.0 OFL-1.1
    OpenSSL OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 Ruby Sleepycat UPL-1.0 Unicode-DFS-2016 Unlicense Vim W3C
    WTFPL X11 Zlib ZPL-2.1""".split()
#: Lines that often stand above a full text that does not begin with them.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "All rights reserved.", "BSD 2-Clause License\nAll rights reserved."],
    "BSD-3-Clause": ["BSD 3-Clause License", "All rights reserved.", "BSD 3-Clause License\nAll rights reserved."],
}
#: What a canonical text may hold in the midst of a word that no spelling changes.
MARKS = ("licens", "permission", "redistribution")

#: Words with more than one accepted spelling, and the one that stands for them.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense",
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze",
    "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog", "categorise": "categorize",
    "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize",
    "judgement": "judgment", "labelling": "labeling", "labour": "labor", "maximise": "maximize",
    "modelled": "modeled", "offence": "offense", "optimise": "optimize", "organisation": "organization",
    "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization",
    "wilful": "willful", "https": "http",
}

#: Not those that go on in a sentence of a wrapped text ("copyright holders be liable").
_COPYRIGHT = r"(?im)^[\s*#/;.-]*(?:copyright\b(?!\s+(?:holders?|owners?|notices?|laws?|licen[cs]es?|and|or)\b)|\(c\)|©).*$"
_QUOTES = "“”«»\"'’‘`"
_COMMENT = r"(?m)^\s*(?:[*#;%]+|//+|--+|dnl\b|rem\b)"


def canonical(text: Column) -> Column:
    """Words of a text as one line: the form whose digest is looked up."""
    kept = F.regexp_replace(F.regexp_replace(text, _COMMENT, " "), _COPYRIGHT, " ")
    plain = F.lower(F.regexp_replace(kept, f"[{_QUOTES}]", ""))
    words = F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))
    same = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    return F.array_join(F.transform(
        F.split(words, " "), lambda w: F.coalesce(F.element_at(same, w), w)), " ")


def may_match(text: Column, longest: int) -> Column:
    """Whether the canonical form can be as short as the ``longest`` known one (in characters).

    Exact as a filter: ASCII letters and digits stay in the form, but for those of copyright
    lines (texts with a sign of one always pass), up to three of a comment sign on each line,
    and less than a quarter of a word where a spelling is replaced.
    """
    alphabet = string.ascii_letters + string.digits
    kept = F.char_length(text) - F.char_length(F.translate(text, alphabet, ""))
    lines = F.char_length(text) - F.char_length(F.translate(text, "\n\r", "")) + 1
    lower = F.lower(text)
    stated = lower.contains("copyright") | lower.contains("(c)") | lower.contains("©")
    return stated | (kept * 0.75 - lines * 3 <= longest)


def digest(text: Column) -> Column:
    """Digest of a text's canonical form; null without words."""
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def marked(text: Column) -> Column:
    """Whether the canonical form may hold one of ``MARKS``."""
    plain = F.lower(F.translate(text, _QUOTES, ""))
    found = [plain.contains(mark.replace("licens", "licen")) for mark in MARKS]  # licence, license
    return reduce(Column.__or__, found)


def known_texts() -> list[tuple[str, str]]:
    """Notices, SPDX lines and full texts as (licence, text)."""
    full = [(f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    titled = [(name, f"{title}\n\n{text}") for name, text in full for title in TITLES.get(name, [])]
    return KNOWN + [(name, f"SPDX-License-Identifier: {name}") for name in SPDX_IDS] + full + titled


def known_table(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(known or known_texts(), "licence string, text string")


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, licence, n_chars, marked): a row per canonical text, the least licence of equal ones."""
    forms = known.select("licence", canonical(F.col("text")).alias("form")).where("form != ''")
    return forms.groupBy(F.sha2("form", 256).alias("digest")).agg(
        F.min("licence").alias("licence"), F.max(F.char_length("form")).alias("n_chars"),
        F.max(reduce(Column.__or__, [F.col("form").contains(mark) for mark in MARKS])).alias("marked"))


def _units(docs: DataFrame) -> DataFrame:
    """(doc_id, unit, text): the document, its paragraphs and its lines."""
    whole = F.array(F.struct(F.lit("document").alias("unit"), F.lit(0).alias("at"), F.col("text").alias("text")))

    def parts(name: str, pattern: str) -> Column:
        return F.transform(F.split("text", pattern, -1), lambda t, i: F.struct(
            F.lit(name).alias("unit"), i.alias("at"), t.alias("text")))

    has_lines = F.instr("text", "\n") > 0
    none = F.array().cast("array<struct<unit: string, at: int, text: string>>")
    units = F.concat(
        whole, F.when(F.col("text").rlike(r"\n\s*\n"), parts("paragraph", r"\n\s*\n")).otherwise(none),
        F.when(has_lines, parts("line", "\n")).otherwise(none))
    return docs.where("text IS NOT NULL").select("doc_id", F.explode(units).alias("u")).select(
        "doc_id", "u.*")


def licence_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, unit, at, licence): every unit of a document that is a known text as a whole.

    ``unit`` is document, paragraph or line, ``at`` its number from 0.
    """
    digests, n = counted(known_digests(known), "licence-digests")
    longest, all_marked = digests.agg(F.max("n_chars"), F.min("marked")).first()
    able = may_match(F.col("text"), longest or 0)
    if all_marked:
        docs, able = docs.where(marked(F.col("text"))), marked(F.col("text")) & able
    units = _units(docs).where(able)
    rows = units.select("doc_id", "unit", "at", digest(F.col("text")).alias("digest"))
    return rows.where("digest IS NOT NULL").join(
        small(digests.select("digest", "licence"), n), "digest").select(
        "doc_id", "unit", "at", "licence")


def document_licences(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, licences, n_units): documents with at least one match."""
    found = saved(licence_scan(docs, known), "licence-units")
    return found.groupBy("doc_id").agg(
        F.sort_array(F.collect_set("licence")).alias("licences"), F.count(F.lit(1)).alias("n_units"))
