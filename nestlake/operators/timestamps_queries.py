"""Problem 5 over archive_entries and udf_volumes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nestlake.operators.timestamps import normaliser
from nestlake.runtime import table

#: What is known of these tables: all their instants lie between 2011 and 2036.
SINCE, UNTIL = datetime(2010, 12, 31), datetime(2037, 1, 2)
#: Two times further apart than this contradict each other.
TOLERANCE_US = 60 * 1_000_000


def _pairs(spark: SparkSession, d: str, src: str) -> DataFrame:
    """(rec_id, a, b): both converted time columns of a table."""
    at = normaliser(SINCE, UNTIL)
    if src == "archive_entries":
        t = table(spark, d, src).select(F.col("entry_id").alias("rec_id"), F.col("creation_date").alias("x"), F.col("last_modified_date").alias("y"), "site_tz")
    else:
        t = table(spark, d, src).select(F.col("pv_id").alias("rec_id"), F.col("pv_datetime").alias("x"), F.col("pv_timestamp").cast("string").alias("y"), "site_tz")
    return t.select("rec_id", at("x", "site_tz").alias("a"), at("y", "site_tz").alias("b"))


FIELDS = {"archive_entries": ("creation_date", "last_modified_date"), "udf_volumes": ("pv_datetime", "pv_timestamp")}


def _us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for src, (x, y) in FIELDS.items():
        p = _pairs(spark, d, src)
        say = lambda f, k: F.struct(F.lit(f).alias("field"), k.alias("kind"))
        odd = lambda c: c["status"].isin("ambiguous", "nonexistent")
        a, b = F.col("a"), F.col("b")
        gap = _us(a["instant"]) - _us(b["instant"])
        last = say(x, F.lit("order")) if src == "archive_entries" else say(y, F.lit("disagree"))
        wrong = (gap if src == "archive_entries" else F.abs(gap)) > TOLERANCE_US
        cases = F.array_compact(F.array(F.when(odd(a), say(x, a["status"])), F.when(odd(b), say(y, b["status"])), F.when(wrong, last)))
        part = p.select(F.lit(src).alias("src"), "rec_id", F.explode(cases).alias("c")).select("src", "rec_id", "c.field", "c.kind")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def p5_times(spark: SparkSession, d: str) -> DataFrame:
    """Every time of both tables in its one form, ISO 8601 in UTC: (src, rec_id, field, instant, status)."""
    out = None
    for src, names in FIELDS.items():
        p = _pairs(spark, d, src)
        both = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"{c}.instant").alias("at"), F.col(f"{c}.status").alias("status")) for n, c in zip(names, "ab", strict=True)])
        part = p.select(F.lit(src).alias("src"), "rec_id", F.explode(both).alias("c")).select(
            "src", "rec_id", "c.field", F.date_format("c.at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("instant"), "c.status")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


QUERIES = {"p5_found": p5_found, "p5_times": p5_times}

# Local times: the two offsets around a local time give two candidates; those that lead back to it are its instants.
_BASE = r"""
WITH x AS (SELECT 'archive_entries' AS src, entry_id AS rec_id, 'creation_date' AS field, creation_date AS raw, site_tz FROM archive_entries
  UNION SELECT 'archive_entries', entry_id, 'last_modified_date', last_modified_date, site_tz FROM archive_entries
  UNION SELECT 'udf_volumes', pv_id, 'pv_datetime', pv_datetime, site_tz FROM udf_volumes
  UNION SELECT 'udf_volumes', pv_id, 'pv_timestamp', CAST(pv_timestamp AS VARCHAR), site_tz FROM udf_volumes),
s AS (SELECT src, rec_id, field, trim(raw) AS v, coalesce(site_tz, 'UTC') AS tz, coalesce(trim(raw), '') IN ('', '0', 'INVALID') AS empty FROM x),
n AS (SELECT *, TRY_CAST(CASE WHEN regexp_full_match(v, '\d{5,19}(\.\d+)?') THEN v END AS DECIMAL(28, 9)) AS num,
  regexp_extract(v, ' ?([+-]\d\d:?\d\d(:\d\d)?)$', 1) AS off, regexp_extract(v, ' ([A-Z]{3,4})$', 1) AS ab FROM s),
b AS (SELECT *, CASE WHEN num IS NULL AND ab = '' THEN regexp_replace(v, ' ?[+-]\d\d:?\d\d(:\d\d)?$|Z$', '') WHEN num IS NULL THEN left(v, length(v) - length(ab) - 1) END AS body FROM n),
l AS (SELECT *, coalesce(TRY_STRPTIME(body, '%Y%m%dT%H%M%S'), TRY_STRPTIME(body, '%d.%m.%Y %H:%M'), TRY_STRPTIME(body, '%a, %d %b %Y %H:%M:%S'), TRY_STRPTIME(v, '%m/%d/%Y %I:%M:%S %p'),
    TRY_STRPTIME(replace(body, 'T', ' '), '%Y-%m-%d %H:%M:%S.%f'), TRY_STRPTIME(replace(body, 'T', ' '), '%Y-%m-%d %H:%M:%S')) AS lt,
  CASE ab WHEN 'CET' THEN 60 WHEN 'CEST' THEN 120 WHEN 'GMT' THEN 0 WHEN 'UTC' THEN 0 WHEN 'BST' THEN 60 WHEN 'EST' THEN -300 WHEN 'EDT' THEN -240 WHEN 'CST' THEN -360 WHEN 'CDT' THEN -300
    WHEN 'JST' THEN 540 WHEN 'IST' THEN 330 WHEN 'AEST' THEN 600 WHEN 'AEDT' THEN 660 END AS ab_min,
  CASE WHEN off <> '' THEN (CASE WHEN off[1] = '-' THEN -1 ELSE 1 END) * (CAST(off[2:3] AS INTEGER) * 60 + CAST(replace(off, ':', '')[4:5] AS INTEGER)) WHEN right(v, 1) = 'Z' THEN 0 END AS off_min FROM b),
o AS (SELECT *, (lt - INTERVAL 1 DAY) AS d1, (lt + INTERVAL 1 DAY) AS d2 FROM l),
f AS (SELECT *, lt - (timezone(tz, timezone('UTC', d1)) - d1) AS u1, lt - (timezone(tz, timezone('UTC', d2)) - d2) AS u2 FROM o),
k AS (SELECT *, timezone(tz, timezone('UTC', u1)) = lt AS ok1, timezone(tz, timezone('UTC', u2)) = lt AS ok2 FROM f),
t AS (SELECT src, rec_id, field, CASE WHEN empty THEN 'none' WHEN num IS NOT NULL OR coalesce(off_min, ab_min) IS NOT NULL OR (u1 = u2 AND ok1) OR ok1 <> ok2 THEN 'ok'
    WHEN ok1 AND ok2 THEN 'ambiguous' WHEN lt IS NOT NULL THEN 'nonexistent' ELSE 'unparsed' END AS status,
  CASE WHEN empty THEN NULL WHEN num IS NOT NULL THEN make_timestamp(CAST(floor(CASE WHEN num BETWEEN 1293753600 AND 2114467200 THEN num * 1000000 WHEN num BETWEEN 1293753600000 AND 2114467200000 THEN num * 1000
      WHEN num BETWEEN 1293753600000000 AND 2114467200000000 THEN num WHEN num > 100000000000000000 THEN CAST(num AS BIGINT) // 10 - 11644473600000000 END) AS BIGINT))
    WHEN coalesce(off_min, ab_min) IS NOT NULL THEN lt - to_minutes(coalesce(off_min, ab_min)) WHEN (u1 = u2 AND ok1) OR (ok1 AND NOT ok2) THEN u1 WHEN ok2 AND NOT ok1 THEN u2 END AS instant FROM k)
"""
SQL = {
    "p5_times": _BASE + "SELECT DISTINCT src, rec_id, field, strftime(instant, '%Y-%m-%dT%H:%M:%S.%fZ') AS instant, status FROM t",
    "p5_found": _BASE + """, w AS (SELECT src, rec_id, max(instant) FILTER (WHERE field IN ('creation_date', 'pv_datetime')) AS a, max(instant) FILTER (WHERE field IN ('last_modified_date', 'pv_timestamp')) AS b FROM t GROUP BY src, rec_id)
SELECT src, rec_id, field, status AS kind FROM t WHERE status IN ('ambiguous', 'nonexistent')
UNION SELECT src, rec_id, 'creation_date', 'order' FROM w WHERE src = 'archive_entries' AND epoch_us(a) - epoch_us(b) > 60000000
UNION SELECT src, rec_id, 'pv_timestamp', 'disagree' FROM w WHERE src = 'udf_volumes' AND abs(epoch_us(a) - epoch_us(b)) > 60000000""",
}
