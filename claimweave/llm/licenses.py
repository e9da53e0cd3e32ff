"""Licence scans by canonical digest lookup.

A unit is the whole text of a document or one of its lines.  Units are normalised (case,
punctuation, blanks, copyright lines, equivalent spellings) and their SHA-256 digests are
joined to those of known licence texts and notices, normalised by the same expression.
Whole texts lie in ``license_texts``, one file each, named by licence; a text with an
appendix on how to apply it is known without it too, and a short one under its title.

Defined cases: a null, empty or blank text has no units that match; a one-line text can
match as text and as line; a licence known under several texts is found by any; equal rows
are each reported; a licence inside a longer line or spread over lines of other text is
not an entire unit and is not reported.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import documents, pick

_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
    "USE OR PERFORMANCE OF THIS SOFTWARE."
)
# Known texts and notices: (licence, text).
KNOWN = (
    ("MIT", "MIT License\n" + _PERMISSION),
    ("MIT", _PERMISSION),
    ("ISC", "ISC License\n" + _ISC),
    ("ISC", _ISC),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
# Spellings taken as one, applied in this order to lower-case text without punctuation.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("favour", "favor"),
    ("copyright owner", "copyright holder"),
    ("version", "v"),
    ("v ", "v"),
)
COPYRIGHT_LINE = r"(?m)^[^a-z0-9©\n]*(copyright|\(c\)|©)[^\n]*[0-9]{4}[^\n]*$"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    out = F.regexp_replace(out, r"all rights reserved", " ")
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    for spelled, taken in SPELLINGS:
        out = F.replace(out, F.lit(spelled), F.lit(taken))
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


TEXTS = Path(__file__).parent / "license_texts"
TITLES = {"BSD-2-Clause": "BSD 2-Clause License\n", "BSD-3-Clause": "BSD 3-Clause License\n"}
TERMS_END = "END OF TERMS AND CONDITIONS"


def known_texts(folder: Path = TEXTS) -> list[tuple[str, str]]:
    """``KNOWN`` and the whole texts, in the forms in which they are found."""
    out = list(KNOWN)
    for file in sorted(folder.glob("*.txt")):
        text = file.read_text(encoding="utf-8", errors="replace")
        terms, end, _ = text.partition(TERMS_END)
        forms = [text, *([terms, terms + end] if end else []), *([TITLES[file.stem] + text] if file.stem in TITLES else [])]
        out += [(file.stem, form) for form in forms]
    return out


def known_digests(spark: SparkSession, known=None) -> DataFrame:
    known = known_texts() if known is None else known
    rows = spark.createDataFrame([(k, t) for k, t in known], "license string, _text string")
    return rows.select("license", digest(F.col("_text")).alias("digest")).distinct()


def licensed(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, unit (text or line), line (from 0; null for the text), license of every match."""
    whole = F.struct(F.lit(None).cast("int").alias("line"), F.col("text").alias("part"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("part")))
    units = pick(docs, "doc_id", "text").select("doc_id", F.explode(F.concat(F.array(whole), lines)).alias("u"))
    keyed = units.select("doc_id", F.col("u.line").alias("line"), digest(F.col("u.part")).alias("digest"))
    return keyed.join(known.select("license", "digest"), "digest").select(
        "doc_id", F.when(F.col("line").isNull(), "text").otherwise("line").alias("unit"), "line", "license"
    )


def op8_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licensed(documents(spark, sf_dir), known_digests(spark))


def _sql() -> str:
    def normal(t: str) -> str:
        out = f"regexp_replace(lower({t}), '{COPYRIGHT_LINE}', ' ', 'g')"
        out = f"regexp_replace({out}, 'all rights reserved', ' ', 'g')"
        out = f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        for spelled, taken in SPELLINGS:
            out = f"replace({out}, '{spelled}', '{taken}')"
        return f"sha256({out})"

    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in KNOWN)
    return f"""WITH known AS (SELECT DISTINCT license, {normal('t')} AS digest FROM (VALUES {values}) v(license, t)),
        parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
        units AS (SELECT doc_id, NULL::INTEGER AS line, text AS part FROM documents WHERE text IS NOT NULL
            UNION ALL SELECT doc_id, unnest(range(len(p)))::INTEGER, unnest(p) FROM parts)
        SELECT doc_id, CASE WHEN line IS NULL THEN 'text' ELSE 'line' END AS unit, line, license
        FROM units JOIN known ON {normal('part')} = digest"""


SQL = _sql()
