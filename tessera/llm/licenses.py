"""Canonical digest lookup of licence texts, with built-in functions only.

A text is reduced to a canonical form (case, punctuation, copyright lines, equivalent spellings, white space), digested,
and hash-joined to the digests of known licences. Two kinds of texts are looked up: the entire document, and each entire
line of it, for the one-line notices that stand in for a licence. Known are the notices below and the public licence texts in
`licences/`, with and without their usual titles.

Defined results: null and blank texts have no licence and the digest of the empty text; a null doc_id keeps its row, but
lines are linked by doc_id, so it has no notices; rows that repeat a doc_id share the notices of all of them; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Short notices of public licences, in natural order.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 3.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License."],
}
# Titles that stand before a licence's text, in natural order. The text alone is known, too.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "All rights reserved."],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "All rights reserved."],
    "Zlib": ["zlib License", "The zlib License"],
    "Unlicense": ["The Unlicense"],
}


def full_texts() -> dict[str, list[str]]:
    """Public licence texts beside this module, one file each, named for the licence and perhaps the part of it."""
    out: dict[str, list[str]] = {}
    for path in sorted((Path(__file__).parent / "licences").glob("*.txt")):
        body, name = path.read_text("utf-8"), path.stem.removesuffix("-notice").removesuffix("-terms")
        out.setdefault(name, []).extend(["\n\n".join(x) for x in [(body,), *((t, body) for t in TITLES.get(name, []))]])
    return out


# Equivalent spellings, replaced as whole words after case and punctuation are gone.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense",
    "acknowledgement": "acknowledgment", "favour": "favor", "honour": "honor", "merchantibility": "merchantability",
    "organisation": "organization", "whilst": "while", "wilful": "willful", "analogue": "analog", "https": "http",
    "v2": "version 2", "v3": "version 3",
}


def canonical(text: Column) -> Column:
    """Canonical form: lower case, no copyright lines, no punctuation, one spelling, single spaces."""
    low = F.lower(F.coalesce(text, F.lit("")))
    plain = F.regexp_replace(low, "(?m)^[^\\p{L}\\p{N}\\n]*(copyright|\\(c\\)|\\u00A9)([^\\p{L}\\n][^\\n]*)?$", "")
    out = F.trim(F.regexp_replace(plain, "[^\\p{L}\\p{N}]+", " "))
    first = "|".join(SPELLINGS)
    spelled = F.concat(F.lit(" "), F.replace(out, F.lit(" "), F.lit("  ")), F.lit(" "))
    for old, new in SPELLINGS.items():
        spelled = F.replace(spelled, F.lit(f" {old} "), F.lit(f" {new} "))
    # most texts have none of the words, so one test spares the replacements
    return F.when(out.rlike(f"\\b({first})\\b"), F.trim(F.replace(spelled, F.lit("  "), F.lit(" ")))).otherwise(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_texts() -> dict[str, list[str]]:
    full = full_texts()
    return {k: [*NOTICES.get(k, []), *full.get(k, [])] for k in {**NOTICES, **full}}


def known(spark: SparkSession, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """(known_digest, license_id) of the given texts, by default of the texts and notices above."""
    rows = [(i, t) for i, ts in (texts or known_texts()).items() for t in ts]
    raw = spark.createDataFrame(rows, "license_id string, known_text string")
    return raw.select(digest(F.col("known_text")).alias("known_digest"), "license_id").groupBy("known_digest").agg(
        F.min("license_id").alias("license_id")
    )


def _lookup(units: DataFrame, licences: DataFrame, small: bool, how: str) -> DataFrame:
    side = F.broadcast(licences) if small else licences
    return units.join(side, units["digest"] == side["known_digest"], how).drop("known_digest")


def scan(docs: DataFrame, licences: DataFrame | None = None, max_broadcast: int = 1_000_000) -> DataFrame:
    """doc_id, digest (of the entire text), license_id (or null) and notices (sorted ids of entire lines).

    licences: rows (known_digest, license_id). Up to max_broadcast rows, about 100 MB, they are broadcast; beyond that
    both sides are shuffled by digest.
    """
    licences = licences if licences is not None else known(docs.sparkSession)
    small = licences.limit(max_broadcast + 1).count() <= max_broadcast
    whole = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    lines = docs.where("doc_id is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("doc_id", digest(F.col("line")).alias("digest"))
    found = _lookup(lines, licences, small, "inner").groupBy("doc_id").agg(
        F.array_sort(F.collect_set("license_id")).alias("notices")
    )
    out = _lookup(whole, licences, small, "left").join(found, "doc_id", "left")
    return out.select("doc_id", "digest", "license_id", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
