"""Licence scans: canonical forms of whole texts and of their lines, looked up among digests of known licences.

The canonical form follows the matching guidelines for licence lists in spirit: case, punctuation and white space don't count, copyright
lines don't count, and equivalent spellings are one. It is made line by line, so that a notice that stands in a line of a longer document and
a document that is a licence as a whole come out of one pass. Digests are joined by hash; nothing is compared by similarity. Everything
is a SQL expression.

Long licences. ``license_digests.txt`` has the digests of the complete texts in ``license_texts``, in two forms: the canonical form,
and the flow form, which leaves out copyright lines at the top alone and so doesn't depend on where lines end. A whole text is looked up in both.

Defined results: a null or empty text has the canonical form "" and matches nothing. Every row is a document, also where doc_id repeats
or is null. Where several known licences have one canonical form, the smallest name is taken for a whole text and all are listed for lines. An
empty table of documents or of licences gives no matches. Texts of any length are taken whole.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import pick, written

#: Equivalent spellings, each as whole words. Fixed values.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("recognise", "recognize"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("per cent", "percent"),
    ("owner s", "owners"),
    ("v 2 0", "version 2 0"),
    ("v2 0", "version 2 0"),
    ("v3", "version 3"),
    ("version 3 0", "version 3"),
    ("cc by nc", "creative commons attribution noncommercial"),
)

#: Known licence texts and notices by name. Fixed values.
_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_NOTICE = """, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n" + _MIT_BODY),
    ("MIT", "The MIT License\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n" + _MIT_BODY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This software is released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC_GRANT + _ISC_NOTICE + "\n" + _ISC_WARRANTY),
    ("ISC", "ISC License\n" + _ISC_GRANT + _ISC_NOTICE + "\n" + _ISC_WARRANTY),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_WARRANTY),
    ("0BSD", "SPDX-License-Identifier: 0BSD"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License.""",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under Creative Commons Attribution-NonCommercial 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means.""",
    ),
)

#: A canonical line that only says who holds the copyright. Fixed value.
COPYRIGHT_LINE = "^(copyright|c|all rights reserved)( |$)"


#: ``digest license`` of the complete texts, a line each, in both forms.
WHOLE_TEXTS = Path(__file__).with_name("license_digests.txt")


def spelled_lines(text: Column) -> Column:
    """Canonical form of each line, without empty ones: an array."""
    # The sign becomes a word before it goes with the punctuation.
    spelled = F.replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("©"), F.lit(" copyright ")), F.lit("(c)"), F.lit(" copyright "))
    # A space at both ends of each line and between words lets whole words be replaced literally.
    words = F.concat(F.lit(" "), F.regexp_replace(spelled, r"[^\p{L}\p{N}\n]+", " "), F.lit(" "))
    words = F.replace(words, F.lit("\n"), F.lit(" \n "))
    # Ends of lines may now hold two spaces; that is mended per line below.
    for old, new in SPELLINGS:
        words = F.replace(words, F.lit(f" {old} "), F.lit(f" {new} "))
    lines = F.transform(F.split(words, "\n", -1), lambda line: F.trim(line))
    return F.filter(lines, lambda line: line != "")


def without_copyright(lines: Column) -> Column:
    return F.filter(lines, lambda line: ~line.rlike(COPYRIGHT_LINE))


def canonical_lines(text: Column) -> Column:
    """Canonical form of each line, without empty and copyright lines: an array."""
    return without_copyright(spelled_lines(text))


def flow_form(lines: Column) -> Column:
    """Of spelled lines: those from the first that isn't a copyright line on."""
    first = F.array_position(F.transform(lines, lambda line: ~line.rlike(COPYRIGHT_LINE)), True)
    joined = F.concat(F.lit(" "), F.array_join(F.slice(lines, first.cast("int"), F.size(lines)), " "), F.lit(" "))
    # Spellings of several words that a line end parted.
    for old, new in SPELLINGS:
        if " " in old:
            joined = F.replace(joined, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.when(first > 0, F.trim(joined)).otherwise("")


def whole_form(lines: Column) -> Column:
    return F.array_join(lines, " ")


def known_licenses(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """``digest, license`` once for each form of the known texts and of the whole texts: the names of one form joined by a comma."""
    pairs = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in known))
    rows = spark.range(1).select(F.inline(pairs))
    form = whole_form(canonical_lines(F.col("text")))
    listed = F.transform(F.split(F.lit(WHOLE_TEXTS.read_text().strip()), "\n"), lambda x: F.split(x, " "))
    whole = spark.range(1).select(F.explode(listed).alias("x")).select(F.col("x")[0].alias("digest"), F.col("x")[1].alias("license"))
    return (
        rows.select("license", form.alias("form"))
        .where("form <> ''")
        .select(F.md5("form").alias("digest"), "license")
        .union(whole)
        .groupBy("digest")
        .agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("license"))
    )


def whole_digests(spark: SparkSession) -> list[str]:
    """The lines of ``license_digests.txt``, made anew from ``license_texts``. A file is named after its licence; a plus sign begins a variant."""
    texts = [(p.stem.partition("+")[0], p.read_text()) for p in sorted(WHOLE_TEXTS.with_name("license_texts").glob("*.txt"))]
    lines = spelled_lines(F.col("text"))
    forms = spark.createDataFrame(texts, "license string, text string").select(
        "license", F.explode(F.array(whole_form(without_copyright(lines)), flow_form(lines))).alias("form")
    )
    return sorted(f"{r.digest} {r.license}" for r in forms.select(F.md5("form").alias("digest"), "license").distinct().collect())


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_digest, license, notices, n_notices`` per row of ``docs``.

    ``license``: the known licence that the entire text is, null if none. ``notices``: licences of its lines that are known
    notices as a whole, sorted and comma-joined, null if none; ``n_notices`` counts such lines. ``known`` has (digest, license).
    """
    rows = pick(docs, doc_id=doc_id, text=text)
    spelled = rows.select("doc_id", spelled_lines(F.col("text")).alias("spelled"))
    lines = spelled.select("doc_id", "spelled", without_copyright(F.col("spelled")).alias("lines"))
    # Digests alone are kept: the texts are read once. The row number is fixed by the written table.
    forms = written(
        lines.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.md5(whole_form(F.col("lines"))).alias("text_digest"),
            F.unhex(F.md5(flow_form(F.col("spelled")))).alias("flow_digest"),
            F.transform("lines", lambda line: F.unhex(F.md5(line))).alias("line_digests"),
        ),
        "license-forms",
    )
    by_line = known.select(F.unhex("digest").alias("line_digest"), F.col("license").alias("notice"))
    found = (
        forms.select("row", F.explode("line_digests").alias("line_digest"))
        .join(by_line, "line_digest")
        .groupBy("row")
        .agg(F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("notices"), F.count(F.lit(1)).alias("n_notices"))
    )
    by_flow = known.select(F.unhex("digest").alias("flow_digest"), F.col("license").alias("flowing"))
    return (
        forms.select("row", "doc_id", "text_digest", "flow_digest")
        .join(known.select(F.col("digest").alias("text_digest"), "license"), "text_digest", "left")
        .join(by_flow, "flow_digest", "left")
        .join(found, "row", "left")
        .select("doc_id", "text_digest", F.coalesce("license", "flowing").alias("license"), "notices", F.coalesce("n_notices", F.lit(0)).alias("n_notices"))
    )


def query(docs: DataFrame) -> DataFrame:
    return scan(docs, known_licenses(docs.sparkSession))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _oracle() -> str:
    spelled = "replace(replace(lower(coalesce(text, '')), '©', ' copyright '), '(c)', ' copyright ')"
    words = f"replace(' ' || regexp_replace({spelled}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') || ' ', chr(10), ' ' || chr(10) || ' ')"
    for old, new in SPELLINGS:
        words = f"replace({words}, ' {old} ', ' {new} ')"
    lines = (
        f"list_filter(list_transform(string_split({words}, chr(10)), lambda x: trim(x)), "
        f"lambda x: x <> '' AND NOT regexp_matches(x, '{COPYRIGHT_LINE}'))"
    )
    values = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in KNOWN)
    return f"""
WITH k AS (
  SELECT md5(array_to_string(lines, ' ')) AS digest, string_agg(DISTINCT license, ',' ORDER BY license) AS license
  FROM (SELECT license, {lines} AS lines FROM (VALUES {values}) v(license, text)) GROUP BY 1
), d AS (SELECT doc_id, {lines} AS lines FROM documents
), n AS (
  SELECT l.doc_id, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS notices, count(*) AS n_notices
  FROM (SELECT doc_id, md5(unnest(lines)) AS digest FROM d) l JOIN k ON k.digest = l.digest GROUP BY 1
)
SELECT d.doc_id, md5(array_to_string(d.lines, ' ')) AS text_digest, k.license, n.notices, coalesce(n.n_notices, 0) AS n_notices
FROM d LEFT JOIN k ON k.digest = md5(array_to_string(d.lines, ' ')) LEFT JOIN n ON n.doc_id = d.doc_id
"""


ORACLE = _oracle()
