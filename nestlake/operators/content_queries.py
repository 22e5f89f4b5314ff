"""Content queries: text features over documents, processors and dissection over content made from documents."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestlake.functions import textfeatures as T
from nestlake.operators.ingest import dissect
from nestlake.runtime import table
from nestlake.sources.content import detect_type, entropy, hashes


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL")


def text_features(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", *[c.cast("long").alias(n) for n, c in T.counts("text").items()])


def text_number_class(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.number_class("text").alias("symbol")).where("symbol IS NOT NULL")


def text_uris(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.explode(T.uris("text")).alias("uri"))


def text_hosts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.explode(T.hosts("text")).alias("host"))


def text_all_ascii(spark: SparkSession, d: str) -> DataFrame:
    n = T.counts("text")
    return _docs(spark, d).where(n["number_of_characters"] == n["number_of_ascii_range_chars"]).select("doc_id")


def text_cc_luhn(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a card-like number was added to: those whose number passes the check, as the processor would flag them."""
    digits = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    number = F.concat(F.lit("card 4539-"), F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 4), F.lit(" "), F.substring(digits, 9, 4), F.lit(". "))
    return _docs(spark, d).select("doc_id", F.concat(number, "text").alias("text")).where(T.has_card_number("text")).select("doc_id")


def text_passwords(spark: SparkSession, d: str) -> DataFrame:
    """Documents with lines added that name passwords, or nearly do."""
    key = F.col("doc_id").cast("string")
    text = F.concat("text", F.lit("\nlogin password: a"), key, F.lit("\nthe code was b"), key, F.lit("\nPassphrase- c"), key, F.lit("\nkey - d"), key, F.lit("\nkey is e"), key)
    return _docs(spark, d).select("doc_id", text.alias("text")).select("doc_id", F.explode(T.passwords("text")).alias("password"))


def text_natural_language(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.natural_language("text").alias("natural_language")).where("natural_language IS NOT NULL")


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    c = _docs(spark, d).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    h = hashes("content")
    return c.select("doc_id", h["md5"].alias("md5"), h["sha1"].alias("sha1"), h["sha256"].alias("sha256"))


def content_entropy(spark: SparkSession, d: str) -> DataFrame:
    c = _docs(spark, d).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return c.select("doc_id", F.round(entropy("content"), 6).alias("entropy"), detect_type("content").alias("kind"))


_PAGE = "<html lang='{l}'><head><meta charset=utf-8></head><body><h1>{i}</h1><p>{t}</p><a href='https://h{m}.example.org/{i}'>x</a><img src='https://img.example.net/{i}.png'></body></html>"


def _submit(spark: SparkSession, d: str, pack) -> DataFrame:
    """Every document packed into a container: content that needs two or more levels of dissection."""

    @F.pandas_udf("binary")
    def made(i: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([pack(int(a), b) for a, b in zip(i, t, strict=True)])

    return _docs(spark, d).select(F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("work_id"), F.coalesce("org", F.lit("default")).alias("org"), F.lit("2024-01-01").cast("timestamp").alias("t"),
                                  made("doc_id", "text").alias("content"), F.lit("{}").alias("props"))


def page(i: int, t: str) -> bytes:
    return _PAGE.format(l="en", i=i, m=i % 7, t=t.replace("&", "&amp;").replace("<", "&lt;")).encode()


def zipped(i: int, t: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("page.html"), page(i, t))
        inner = io.BytesIO()
        with tarfile.open(fileobj=inner, mode="w", format=tarfile.USTAR_FORMAT) as tar:
            info = tarfile.TarInfo("note.txt")
            body = f"note {i}\n".encode() + t.encode()
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
        z.writestr(zipfile.ZipInfo("inner.tar"), inner.getvalue())
    return out.getvalue()


def ingest_tree(spark: SparkSession, d: str) -> DataFrame:
    """Objects of each work by level and type, after dissection of every document in an archive in an archive."""
    objects, _ = dissect(_submit(spark, d, zipped))
    return objects.groupBy("work_id", "recursion_level", "object_type", "is_entry").agg(F.count(F.lit(1)).alias("n"))


def html_domains(spark: SparkSession, d: str) -> DataFrame:
    objects, rels = dissect(_submit(spark, d, page))
    found = objects.where("object_type = 'Domain' AND recursion_level = 2")  # of the page, not of texts taken out of it
    found = found.select("id", "work_id")
    return found.join(rels.select(F.col("child").alias("id"), "props"), "id").select("work_id", F.get_json_object("props", "$.name").alias("domain"))


QUERIES = {f.__name__: f for f in (text_features, text_number_class, text_uris, text_hosts, text_all_ascii, text_cc_luhn, text_passwords, text_natural_language, content_hashes, content_entropy, ingest_tree, html_domains)}

_N = """WITH c AS (SELECT doc_id, text, length(text) AS n, length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS dg, length(text) - length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS a,
  length(text) - length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g')) AS ws, length(text) - length(regexp_replace(text, '\\n', '', 'g')) AS nl,
  len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS wd FROM documents WHERE text IS NOT NULL) """
_U = r"""regexp_extract_all(text, '(?i)\b((?:https?|ftp)://[^\s<>"''`{}|\\^\[\]]*[^\s<>"''`{}|\\^\[\].,;:!?()])', 1)"""
_WORDS = ", ".join("(len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{w}'" for w in ws) + f"))), '{name}')" for name, ws in T.FUNCTION_WORDS.items())
SQL = {
    "text_natural_language": rf"""WITH c AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{{L}}]+') AS w FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, list_reverse_sort([{_WORDS}]) AS a FROM c)
SELECT doc_id, a[1][2] AS natural_language FROM n WHERE a[1][1] >= {T.LEAST_WORDS} AND a[1][1] > a[2][1]""",
    "text_features": _N + "SELECT doc_id, n AS number_of_characters, dg AS number_of_digits, a AS number_of_ascii_range_chars, ws AS number_of_whitespaces, nl AS number_of_newlines, CAST(wd AS BIGINT) AS number_of_words FROM c",
    "text_number_class": _N + "SELECT * FROM (SELECT doc_id, CASE WHEN dg = 0 THEN NULL WHEN dg = n - ws THEN 'ALL_NUMBERS' WHEN dg > (n - ws) // 2 THEN 'MOSTLY_NUMBERS' WHEN dg > (n - ws) // 10 THEN 'MANY_NUMBERS' END AS symbol FROM c) WHERE symbol IS NOT NULL",
    "text_uris": f"SELECT doc_id, unnest(list_distinct({_U})) AS uri FROM documents WHERE text IS NOT NULL",
    "text_hosts": f"SELECT DISTINCT doc_id, lower(regexp_extract(u, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host FROM (SELECT doc_id, unnest({_U}) AS u FROM documents WHERE text IS NOT NULL)",
    "text_all_ascii": _N + "SELECT doc_id FROM c WHERE n = a",
    "text_passwords": "SELECT doc_id, p || doc_id AS password FROM documents, (SELECT unnest(['a', 'c', 'e']) AS p) WHERE text IS NOT NULL",
    "text_cc_luhn": """WITH k AS (SELECT doc_id, '4539' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS d FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, i, CAST(d[i] AS INTEGER) * CASE WHEN i % 2 = 1 THEN 2 ELSE 1 END AS v FROM (SELECT *, unnest(range(1, 17)) AS i FROM k))
SELECT doc_id FROM x GROUP BY doc_id HAVING sum(CASE WHEN v > 9 THEN v - 9 ELSE v END) % 10 = 0""",
    "content_hashes": "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL",
    "content_entropy": """WITH h AS (SELECT doc_id, hex(encode(text)) AS x FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, x[2 * i - 1:2 * i] AS b FROM (SELECT doc_id, x, unnest(range(1, len(x) // 2 + 1)) AS i FROM h)),
c AS (SELECT doc_id, b, count(*) AS n FROM b GROUP BY doc_id, b), e AS (SELECT doc_id, -sum(n / t * log2(n / t)) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS t FROM c) GROUP BY doc_id)
SELECT h.doc_id, round(coalesce(e + 0.0, 0), 6) AS entropy, CASE WHEN x = '' THEN 'EMPTY' ELSE 'Text' END AS kind FROM h LEFT JOIN e ON e.doc_id = h.doc_id""",
    "ingest_tree": f"""WITH x AS (SELECT 'w' || doc_id AS work_id, text FROM documents WHERE text IS NOT NULL),
k AS (SELECT unnest([{{'recursion_level': 1, 'object_type': 'ZIP', 'n': 1}}, {{'recursion_level': 2, 'object_type': 'HTML', 'n': 1}}, {{'recursion_level': 2, 'object_type': 'TAR', 'n': 1}},
  {{'recursion_level': 3, 'object_type': 'Domain', 'n': 2}}, {{'recursion_level': 3, 'object_type': 'Text', 'n': 2}}]) AS k),
h AS (SELECT DISTINCT work_id, lower(regexp_extract(u, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host FROM (SELECT work_id, unnest({_U}) AS u FROM x))
SELECT work_id, k.recursion_level, k.object_type, k.recursion_level = 1 AS is_entry, CAST(k.n AS BIGINT) AS n FROM x, k
UNION ALL SELECT work_id, 4, 'Domain', false, 2 * count(*) FROM h WHERE contains(host, '.') AND NOT regexp_full_match(host, '[0-9.]+') GROUP BY work_id""",
    "html_domains": """WITH x AS (SELECT doc_id FROM documents WHERE text IS NOT NULL)
SELECT 'w' || doc_id AS work_id, 'h' || (doc_id % 7) || '.example.org' AS domain FROM x UNION ALL SELECT 'w' || doc_id, 'img.example.net' FROM x""",
}
