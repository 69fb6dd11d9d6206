"""License scans (operator 1): canonical digest lookup.

Lines are normalised (case, punctuation, spacing, equivalent spellings), copyright lines and empty
ones left out, and the rest joined: so neither wrapping nor the holder's name changes a text's digest. Digests of
entire texts are hash-joined to those of known licences; single lines, as far as they are no longer than any known
notice, to those of known notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import DIGESTS, MORE
from .session import checkpoint

#: Licences that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_ROWS = 100_000

#: Equivalent spellings, in the order in which they are replaced.
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("copy right", "copyright")]
COPYRIGHT = r"^((c|©) )?copyright( |$)|^© |^c (19|20)[0-9][0-9]|^all rights reserved$"
#: How a licence's own wording may go on where a line begins with "copyright": such lines stay.
WORDING = r"^copyright (notices?|holders?|owners?|laws?|interests?|licenses?|and|or|in|to|this|the above)( |$)"
#: What separates words: ASCII beside letters and digits, no-break and other Unicode blanks, typographic quotes, dashes, bullets and the mark of an ellipsis.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F\u00A0\u00AB\u00B7\u00BB\u2000-\u200B\u2010-\u2015\u2018-\u201F\u2022\u2026\u202F\u2032\u2033\u2039\u203A\u205F\u2060\u3000\uFEFF]+"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Known licences (id, text) and notices (id, line).
LICENSES = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_DISCLAIMER}"),
    ("ISC", f"ISC License\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_DISCLAIMER}"),
    ("0BSD", f"{_ISC_GRANT}.\n{_ISC_DISCLAIMER}"),
    *MORE,
]
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]


def _line(x: Column) -> Column:
    x = F.trim(F.regexp_replace(F.lower(x), GAP, " "))
    for old, new in SPELLINGS:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def canonical_lines(text: Column) -> Column:
    """Normalised lines without copyright lines and empty ones."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "[\r\n]+", -1), _line)
    return F.filter(lines, lambda x: (x != "") & (~x.rlike(COPYRIGHT) | x.rlike(WORDING)))


def _digests(known: DataFrame, more: DataFrame | None = None) -> DataFrame:
    known = known.select(F.col("license"), F.sha2(F.array_join(canonical_lines(F.col("text")), " "), 256).alias("digest"))
    return (known if more is None else known.unionByName(more.select("license", "digest"))).groupBy("digest").agg(F.min("license").alias("license"))


def _bounded(known: DataFrame) -> DataFrame:
    known = checkpoint(known)
    return F.broadcast(known) if known.count() <= BROADCAST_ROWS else known


def scan_licenses(docs: DataFrame, licenses: DataFrame, notices: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: DataFrame | None = None) -> DataFrame:
    """(id, digest, license, n_notices, notices) for every row; notices: ids in order, comma-joined.

    ``licenses`` and ``notices`` have license and text, ``digests`` has license and digest, for licences whose text is not at hand; of
    licences with one digest the smallest id counts.
    A null or empty text, or one of copyright lines only, has the digest of an empty string and no licence, even
    if a known licence were empty. Rows that repeat an id are scanned each by itself; null ids stay null; an empty
    table gives an empty result; other columns are not read.
    """
    whole = _bounded(_digests(licenses, digests))
    lines = notices.select("license", F.array_join(canonical_lines(F.col("text")), " ").alias("line")).where("line <> ''")
    longest = lines.agg(F.coalesce(F.max(F.length("line")), F.lit(0)).alias("n")).first()["n"]
    single = _bounded(lines.select(F.sha2("line", 256).alias("line_digest"), F.col("license").alias("notice")).distinct())
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), canonical_lines(F.col(text_col)).alias("lines"))
    short = F.array_distinct(F.filter("lines", lambda x: F.length(x) <= longest))
    rows = rows.select("row", "id", F.sha2(F.array_join("lines", " "), 256).alias("digest"), (F.size("lines") == 0).alias("empty"), F.explode_outer(short).alias("line"))
    rows = rows.withColumn("line_digest", F.sha2("line", 256)).join(single, "line_digest", "left")
    one = rows.groupBy("row", "id", "digest", "empty").agg(F.array_sort(F.collect_set("notice")).alias("notices"))
    out = one.join(whole, "digest", "left")
    return out.select(F.col("id").alias(id_col), "digest", F.when(~F.col("empty"), F.col("license")).alias("license"), F.size("notices").cast("long").alias("n_notices"), F.array_join("notices", ",").alias("notices"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(LICENSES, "license string, text string")
    notices = spark.createDataFrame(NOTICES, "license string, text string")
    digests = spark.createDataFrame(DIGESTS, "license string, digest string")
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), known, notices, digests=digests)


def _sql() -> str:
    line = f"trim(regexp_replace(lower(x), '{GAP}', ' ', 'g'))"
    for old, new in SPELLINGS:
        line = f"replace({line}, '{old}', '{new}')"
    values = lambda rows: ", ".join("('" + k + "', '" + t.replace("'", "''") + "')" for k, t in rows)
    return f"""
WITH lic(license, text) AS (VALUES {values(LICENSES)}), more(license, digest) AS (VALUES {values(DIGESTS)}), note(license, text) AS (VALUES {values(NOTICES)}),
every AS (
  SELECT 'd' AS kind, doc_id AS id, '' AS license, text FROM documents UNION ALL SELECT 'l', 0, license, text FROM lic UNION ALL SELECT 'n', 0, license, text FROM note),
norm AS (
  SELECT kind, id, license, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[\\r\\n]+'), lambda x: {line}), lambda x: x <> '' AND (NOT regexp_matches(x, '{COPYRIGHT}') OR regexp_matches(x, '{WORDING}'))) AS lines FROM every),
whole AS (SELECT digest, min(license) AS license FROM (SELECT sha256(array_to_string(lines, ' ')) AS digest, license FROM norm WHERE kind = 'l' UNION ALL SELECT digest, license FROM more) GROUP BY 1),
single AS (SELECT DISTINCT array_to_string(lines, ' ') AS line, license FROM norm WHERE kind = 'n'),
doc AS (SELECT id, lines, sha256(array_to_string(lines, ' ')) AS digest FROM norm WHERE kind = 'd'),
hit AS (SELECT id, list_sort(list_distinct(list(license))) AS notices FROM (SELECT id, unnest(lines) AS line FROM doc) JOIN single USING (line) GROUP BY id)
SELECT doc.id AS doc_id, doc.digest, CASE WHEN len(doc.lines) > 0 THEN whole.license END AS license, CAST(coalesce(len(notices), 0) AS BIGINT) AS n_notices, coalesce(array_to_string(notices, ','), '') AS notices
FROM doc LEFT JOIN whole ON whole.digest = doc.digest LEFT JOIN hit ON hit.id = doc.id
"""


SQL = _sql()
