"""Licence scans by canonical digests.

A text is brought to a canonical form: lower case, without copyright lines, punctuation and white space as one space,
equivalent spellings as one. The digest of the whole canonical text is looked up among the digests of known licences
by an equi-join; each line of a document is looked up as a text of its own, which finds notices inside other text. A known
text over several whole lines is looked for where its first words stand at the start of a line, by an equi-join on them.

Known are the whole texts in ``license_texts``, their usual variants, and header notices.

Defined results: a null text counts as empty; empty texts and lines are no licence; repeated rows and lines are reported
each; the line of a text over several lines is its first; known texts that are equal in canonical form are all reported; empty tables give an empty result.
Other columns are not read, whatever their names; a very long text is canonicalised by one task, which holds a few copies of it.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.llm.common import text_of
from blockloom.session import materialize

# Short notices and licence texts, and spellings that count as equal.
KNOWN = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING"
        " ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,"
        " DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,"
        " WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE"
        " USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
}
#: Header notices, in the words that the licences themselves propose.
_GNU = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published"
    " by the Free Software Foundation; {which}.\nThis program is distributed in the hope that it will be useful, but WITHOUT"
    " ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU"
    " {name} for more details."
)
_LATER = "either version {v}{of} or (at your option) any later version"
NOTICES = [
    ("Apache-2.0", (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with'
        " the License. You may obtain a copy of the License at http{s}://www.apache.org/licenses/LICENSE-2.0\nUnless required"
        " by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\""
        " BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific"
        " language governing permissions and limitations under the License.").replace("{s}", s)) for s in ("", "s")
] + [
    ("MPL-2.0", (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        f" distributed with this file, You can obtain one at http{s}://mozilla.org/MPL/2.0/.")) for s in ("", "s")
] + [
    (f"{short}-{v if '.' in v else v + '.0'}-or-later", _GNU.format(name=name, which=_LATER.format(v=v, of=of)))
    for short, name, versions in (
        ("GPL", "General Public License", "23"), ("AGPL", "Affero General Public License", "3"),
        ("LGPL", "Lesser General Public License", ("2.1", "3")))
    for v in versions for of in (" of the License,", " of the License")
] + [("GPL-2.0-only", _GNU.format(name="General Public License", which="version 2 of the License"))] + [
    (name, f"SPDX-License-Identifier: {name}") for name in (
        "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0",
        "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only",
        "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT",
        "MPL-2.0", "Unlicense", "Zlib")
]
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analog": "analogue", "authorisation": "authorization", "authorised": "authorized",
    "favour": "favor", "fulfil": "fulfill", "licence": "license", "licenced": "licensed", "licencing": "licensing",
    "merchantability": "merchantability", "noncommercial": "non commercial", "organisation": "organization",
    "percent": "per cent", "sublicence": "sublicense", "v2": "version 2", "v3": "version 3", "wilful": "willful",
}
#: So many first words of a known text start the search for it over several lines.
ANCHOR = 3
COPYRIGHT_LINE = r"(?m)^[^\n]*(?:copyright +[(0-9]|\(c\) +[0-9]|©|all rights reserved)[^\n]*$"
VARIANTS = r"\b(?:" + "|".join(SPELLINGS) + r")\b"


def canonical(text: Column) -> Column:
    """The canonical form; its lines are those of the text, each trimmed."""
    text = F.lower(text)
    text = F.when(F.regexp_like(text, F.lit("copyright|\\(c\\)|©|rights reserved")), F.regexp_replace(text, COPYRIGHT_LINE, "")).otherwise(text)
    text = F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " ")
    spelled = text
    for variant, usual in SPELLINGS.items():
        spelled = F.regexp_replace(spelled, rf"\b{variant}\b", usual)
    return F.when(F.regexp_like(text, F.lit(VARIANTS)), spelled).otherwise(text)


def digest(line: Column) -> Column:
    return F.sha2(F.trim(line).cast("binary"), 256)


def whole(canonical_text: Column) -> Column:
    """A canonical text in one line."""
    return F.regexp_replace(canonical_text, r"[ \n]+", " ")


def known_texts() -> list[tuple[str, str]]:
    """``(license id, text)`` of all known texts; one licence may have several."""
    known = {f.name[:-len(".txt")]: f.read_text("utf-8") for f in files("blockloom.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")}
    texts = list(known.items())
    mit = known["MIT"][known["MIT"].index("Permission"):]
    texts += [("MIT", title + mit) for title in ("", "MIT License\n")]
    university = known["BSD-3-Clause"]
    body = university[university.index("Redistribution and"):]
    third = body[body.index("3. Neither"):body.index("THIS SOFTWARE")]
    for name, base in (("BSD-3-Clause", body), ("BSD-2-Clause", body.replace(third, ""))):
        for holder, who, whom in (
            ("the University", "REGENTS", "REGENTS"), ("the copyright holder", "COPYRIGHT HOLDERS", "COPYRIGHT HOLDER"),
            ("the copyright holder", "COPYRIGHT HOLDERS", "COPYRIGHT HOLDERS"), ("the copyright holder", "AUTHOR", "AUTHOR"),
        ):
            held = base.replace("the University", holder).replace("REGENTS AND", f"{who} AND").replace("REGENTS OR", f"{whom} OR")
            for plain in (held, held.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")):
                title = {"BSD-3-Clause": "BSD 3-Clause License\n", "BSD-2-Clause": "BSD 2-Clause License\n"}[name]
                texts += [(name, plain), (name, title + plain)]
    apache = known["Apache-2.0"]
    texts.append(("Apache-2.0", apache[:apache.index("APPENDIX:")]))
    for name, text in known.items():
        end = text.find("END OF TERMS AND CONDITIONS")
        if end > 0 and "GPL" in name:
            texts += [(name, text[:end] + "END OF TERMS AND CONDITIONS"), (name, text[:end])]
    return [*KNOWN.items(), *texts, *NOTICES]


def known_licenses(spark: SparkSession) -> DataFrame:
    """``license_id, text``: every known text once in its canonical form."""
    known = spark.createDataFrame(known_texts(), "license_id string, text string")
    return known.withColumn("_form", digest(whole(canonical(text_of())))).dropDuplicates(["license_id", "_form"]).drop("_form")


def _first_words(text: Column, n: int) -> Column:
    return F.substring_index(text, " ", n)


def wrapped_hits(texts: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, license_id, line``: the known texts that two or more whole lines of a longer document are.

    ``texts`` has ``doc_id`` and ``_canonical``; ``known`` has ``license_id, form``, the canonical text in one line.
    The known texts' first words come to the driver: one short row per known text.
    """
    known = known.where("form <> ''").withColumn("words", F.size(F.split("form", " "))).withColumn(
        "anchor", _first_words(F.col("form"), ANCHOR)).where("words > 1")
    reach: dict[int, dict[str, int]] = {}
    for row in known.groupBy("anchor").agg(F.max("words").alias("words")).collect():
        reach.setdefault(row["anchor"].count(" ") + 1, {})[row["anchor"]] = row["words"]
    if not reach:
        return texts.sparkSession.createDataFrame([], T.StructType([texts.schema["doc_id"], *known.select("license_id").schema.fields,
                                                                    T.StructField("line", T.IntegerType())]))
    lines = F.filter(
        F.transform(F.split("_canonical", "\n"), lambda text, i: F.struct(F.trim(text).alias("text"), i.alias("line"))),
        lambda x: x["text"] != "")
    found = texts.select("doc_id", lines.alias("_lines")).where(F.size("_lines") > 1)
    # A line holds a word or more, so as many lines as an anchor has words hold its words.
    starts = []
    for n, anchors in reach.items():
        most = F.create_map(*[F.lit(x) for pair in anchors.items() for x in pair])
        marked = F.transform("_lines", lambda x, i: F.struct(i.alias("at"), _first_words(
            F.array_join(F.transform(F.slice(F.col("_lines"), i + 1, n), lambda y: y["text"]), " "), n).alias("anchor")))
        starts.append(F.transform(F.filter(marked, lambda m: m["anchor"].isin(*anchors)), lambda m: F.struct(
            m["anchor"].alias("anchor"), m["at"].alias("at"),
            F.slice(F.col("_lines"), m["at"] + 1, F.element_at(most, m["anchor"]) + 1).alias("part"))))
    each = found.select("doc_id", F.size("_lines").alias("_all"), F.explode(F.concat(*starts)).alias("m")).select(
        "doc_id", "_all", "m.anchor", "m.at", F.expr("m.part[0].line").alias("line"),
        F.array_join(F.transform("m.part", lambda x: x["text"]), "\n").alias("part"))
    size = F.length("form")
    same = F.translate(F.left("part", size), "\n", " ") == F.col("form")
    ends = F.substr("part", size + 1, F.lit(1)).isin("", "\n")
    several = F.contains(F.left("part", size), F.lit("\n"))
    entire = (F.col("at") == 0) & (F.length("part") == size) & (F.size(F.split("part", "\n")) == F.col("_all"))
    return each.join(known, "anchor").where(same & ends & several & ~entire).select("doc_id", "license_id", "line")


def license_hits(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, license_id, line``: the licence that a document is (``line`` null) or that one or more of its lines are."""
    forms = materialize(known.select("license_id", F.trim(whole(canonical(text_of()))).alias("form")), "license-forms")
    named = forms.select("license_id", digest(F.col("form")).alias("digest"))
    text = F.col("_canonical")
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(digest(line).alias("digest"), i.alias("line"), F.trim(line) != ""))
    entire = F.array(F.struct(digest(whole(text)).alias("digest"), F.lit(None).cast("int").alias("line"), F.trim(whole(text)) != ""))
    texts = docs.select("doc_id", canonical(text_of()).alias("_canonical"))
    units = texts.select(
        "doc_id", F.inline(F.concat(entire, lines)).alias("digest", "line", "_some"))
    single = units.where("_some").join(named, "digest").select("doc_id", "license_id", "line")
    return single.unionByName(wrapped_hits(texts, forms))
