"""Problem 2: font names of pdf_docs and file names of archive_entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestlake.llm.terms import banded, term_counts
from nestlake.runtime import table


def _fonts(spark: SparkSession, d: str) -> DataFrame:
    """A pdf row sent again counts once: its elements are numbered by their place in the list."""
    p = table(spark, d, "pdf_docs").select(F.col("pdf_id").alias("record"), F.posexplode("fonts").alias("item", "font"))
    return p.select("record", F.col("item").cast("long").alias("item"), F.regexp_replace("font", r"^[A-Z]{6}\+", "").alias("term"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    name = F.regexp_replace("entry_name", r"(?s)^.*[/\\]", "")
    name = F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""))
    return table(spark, d, "archive_entries").select(F.col("archive_id").alias("record"), F.col("entry_id").alias("item"), name.alias("term"))


def _all(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for field, rows, source, key in (("fonts", _fonts, "pdf_docs", "pdf_id"), ("entry_name", _names, "archive_entries", "archive_id")):
        n = table(spark, d, source).agg(F.count_distinct(key)).first()[0]
        part = banded(term_counts(rows(spark, d)), n).select(F.lit(field).alias("field"), "term", "occurrences", "records", "band")
        out = part if out is None else out.unionByName(part)
    return out


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d).where("band IS NOT NULL").select("field", "term", "band")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d)


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts}

_COUNTS = r"""
WITH f AS (SELECT DISTINCT pdf_id AS record, i AS item, fonts[i] AS font FROM (SELECT pdf_id, fonts, unnest(range(1, len(fonts) + 1)) AS i FROM pdf_docs)),
a AS (SELECT DISTINCT archive_id AS record, entry_id AS item, entry_name FROM archive_entries WHERE entry_name IS NOT NULL AND archive_id IS NOT NULL),
t AS (SELECT 'fonts' AS field, record, regexp_replace(font, '^[A-Z]{6}\+', '') AS term FROM f WHERE font IS NOT NULL AND record IS NOT NULL
  UNION ALL SELECT 'entry_name', record, lower(regexp_replace(regexp_replace(entry_name, '^.*[/\\]', '', 's'), '^\s+|\s+$', '', 'g')) FROM a),
n AS (SELECT 'fonts' AS field, count(DISTINCT pdf_id) AS n FROM pdf_docs UNION ALL SELECT 'entry_name', count(DISTINCT archive_id) FROM archive_entries),
c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT record) AS records FROM t GROUP BY field, term),
b AS (SELECT c.field, term, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.1 * n THEN 'common' END AS band FROM c JOIN n ON n.field = c.field)
"""
SQL = {
    "p2_found": _COUNTS + "SELECT field, term, band FROM b WHERE band IS NOT NULL",
    "p2_counts": _COUNTS + "SELECT field, term, occurrences, records, band FROM b",
}
