"""Queries over content made from the documents: each container type dissected, its children compared with the text."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Callable
from email.message import EmailMessage

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestlake.operators.ingest import dissect
from nestlake.plans.compiler import Nodes
from nestlake.plans.search import Store
from nestlake.runtime import table
from nestlake.sources.content import rename_types


def mail(i: int, t: str) -> bytes:
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Date"] = f"a{i}@x.example", "b@y.example", f"Grüße {i}", "Wed, 01 Jul 2020 12:00:00 +0200"
    m.set_content("see the file")
    m.add_attachment(t.encode(), maintype="application", subtype="octet-stream", filename=f"f{i}.bin")
    return m.as_bytes()


def tarred(i: int, t: str) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        info = tarfile.TarInfo(f"d/{i}.txt")
        info.size = len(body := t.encode())
        tar.addfile(info, io.BytesIO(body))
    return out.getvalue()


def zipped(i: int, t: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo(f"{i}.txt"), t)
    return out.getvalue()


def rich(i: int, t: str) -> bytes:
    signs = {"\\": "\\\\", "{": "\\{", "}": "\\}", "\n": "\\par\n", "\t": "\\tab "}
    units = lambda c: "".join(f"\\u{int.from_bytes(u, 'little', signed=True)}?" for u in (c.encode("utf-16-le")[k:k + 2] for k in range(0, 2 * len(c.encode("utf-16-le")) // 2, 2)))
    return ("{\\rtf1\\ansi\\ansicpg1252 " + "".join(signs.get(c) or (c if 32 <= ord(c) < 127 else "" if ord(c) < 32 else units(c)) for c in t) + "}").encode("ascii")


def paged(i: int, t: str) -> bytes:
    lines = [x for x in t.encode("cp1252", "ignore").split(b"\n")]
    body = b"BT\n" + b"".join(b"(" + x.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj 0 -12 Td\n" for x in lines) + b"ET"
    return b"%PDF-1.4\n1 0 obj <</Type /Page>> endobj\n2 0 obj <</Length 1>> stream\n" + body + b"\nendstream endobj\nstartxref\n0\n%%EOF"


#: Packers by the remainder of the document's number: type and how its text gets into it.
PACKERS: tuple[tuple[str, Callable[[int, str], bytes]], ...] = (
    ("TAR", tarred), ("ZIP", zipped), ("GZIP", lambda i, t: gzip.compress(t.encode(), mtime=0)), ("BZIP2", lambda i, t: bz2.compress(t.encode())), ("XZ", lambda i, t: lzma.compress(t.encode())), ("Email", mail))


def _submit(spark: SparkSession, d: str, pack: Callable[[int, str], bytes]) -> DataFrame:
    @F.pandas_udf("binary")
    def made(i: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([pack(int(a), b) for a, b in zip(i, t, strict=True)], dtype=object)

    docs = table(spark, d, "documents").where("text IS NOT NULL AND text <> ''")
    return docs.select(F.col("doc_id").cast("string").alias("work_id"), F.lit("o").alias("org"), F.lit("2024-01-01").cast("timestamp").alias("t"), made("doc_id", "text").alias("content"), F.lit('{"_global": {"by": "us"}}').alias("props"))


def _any(i: int, t: str) -> bytes:
    return PACKERS[i % len(PACKERS)][1](i, t)


def proc_archives(spark: SparkSession, d: str) -> DataFrame:
    """Documents in archives, compressed streams and mails: type of the container, and hash of the child that is the text."""
    objects, rels = dissect(_submit(spark, d, _any), 2)
    kids = objects.where("recursion_level = 2").select("id", "work_id", F.col("hashes")["md5"].alias("md5")).join(rels.select(F.col("child").alias("id"), "props"), "id")
    kids = kids.where(F.coalesce(F.get_json_object("props", "$.mime_type"), F.lit("")) != "text/plain")  # the mail's own words
    top = objects.where("recursion_level = 1").select("work_id", F.col("object_type").alias("kind"))
    return kids.join(top, "work_id").select(F.col("work_id").cast("long").alias("doc_id"), "kind", "md5", F.get_json_object("props", "$._global.by").alias("handed_down"))


def proc_email(spark: SparkSession, d: str) -> DataFrame:
    """Facts of mails made from the documents."""
    objects, _ = dissect(_submit(spark, d, mail), 2)
    m = F.try_variant_get(F.try_parse_json("result"), "$.ok.object_metadata", "variant")
    head = lambda n: F.element_at(F.filter(F.try_variant_get(m, "$.headers", "array<struct<name:string,value:string>>"), lambda h: h["name"] == n), 1)["value"]
    return objects.where("recursion_level = 1").select(
        F.col("work_id").cast("long").alias("doc_id"), head("Subject").alias("subject"), head("From").alias("sender"),
        F.try_variant_get(m, "$.n_attachments", "long").alias("n_attachments"), F.try_variant_get(m, "$.date_ts", "double").cast("long").alias("date_ts"))


def proc_rtf(spark: SparkSession, d: str) -> DataFrame:
    """Text taken out of RTF documents, without white space at either end and other control characters."""
    objects, _ = dissect(_submit(spark, d, rich), 2)
    return objects.where("recursion_level = 2 AND object_type = 'Text'").select(F.col("work_id").cast("long").alias("doc_id"), F.col("hashes")["md5"].alias("md5"))


def proc_pdf(spark: SparkSession, d: str) -> DataFrame:
    """Letters and digits of the text taken out of PDF documents, for those whose text is ASCII."""
    objects, rels = dissect(_submit(spark, d, paged), 2)
    kids = objects.where("recursion_level = 2 AND object_type = 'Text'").join(rels.select(F.col("child").alias("id"), "props"), "id").where(F.get_json_object("props", "$.name") == "text")
    ascii_only = table(spark, d, "documents").where("text IS NOT NULL").where(~F.col("text").rlike(r"[^\x00-\x7F]")).select(F.col("doc_id").cast("string").alias("work_id"))
    return kids.join(ascii_only, "work_id").select(F.col("work_id").cast("long").alias("doc_id"), "size")


MARK, TAIL = "7265766965772e", "2e"  # "review." and "."


def match_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Byte patterns looked for while dissecting, then asked for by their tags."""
    patterns = [(MARK, "*"), ("54686520??6?", "0"), ("6d6f6e*6672??6179", "*")]
    objects, rels = dissect(_submit(spark, d, lambda i, t: t.encode()), 1, patterns=patterns)
    found = Store(Nodes(objects, rels)).matching(f"@match_pattern({MARK}) || @match_pattern(0:54686520??6?) || @match_pattern(6d6f6e*6672??6179)")
    return found.select(F.col("work_id").cast("long").alias("doc_id"))


def url_pages(spark: SparkSession, d: str) -> DataFrame:
    """Addresses joined with a table of fetched pages: what each leads to, one level down."""
    address = F.concat(F.lit("https://h.example/"), F.col("doc_id").cast("string"))
    docs = table(spark, d, "documents").where("text IS NOT NULL AND text <> ''")
    pages = docs.where("doc_id % 3 <> 0").select(address.alias("url"), F.encode("text", "UTF-8").alias("content"))
    urls = docs.select(F.col("doc_id").cast("string").alias("work_id"), F.lit("o").alias("org"), F.lit("2024-01-01").cast("timestamp").alias("t"), F.encode(address, "UTF-8").alias("content"), F.lit("{}").alias("props"), F.lit("URL").alias("object_type"))
    objects, _ = dissect(urls, 2, pages=pages)
    return objects.where("recursion_level = 2 AND object_type <> 'Domain'").select(F.col("work_id").cast("long").alias("doc_id"), F.col("hashes")["md5"].alias("md5"))


def type_renames(spark: SparkSession, d: str) -> DataFrame:
    return rename_types(table(spark, d, "objects").select("id", "object_type").distinct()).groupBy("object_type").agg(F.count(F.lit(1)).alias("n"))


#: Upper bounds of the seconds that processing took.
BOUNDS = (1, 2, 5, 10, 20)


def store_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Of each type: objects, errors, bytes, and how many were processed within so many seconds (a cumulative histogram)."""
    r = F.try_parse_json("result")
    took = F.try_variant_get(r, "$.ok.object_metadata._perf", "double")
    o = table(spark, d, "objects").select("id", "object_type", "size", "result").distinct()
    return o.select("object_type", "size", took.alias("s"), F.try_variant_get(r, "$.error", "string").isNotNull().alias("bad")).groupBy("object_type").agg(
        F.count(F.lit(1)).alias("objects"), F.count_if("bad").alias("errors"), F.sum("size").alias("bytes"), F.count("s").alias("timed"), *[F.count_if(F.col("s") <= b).alias(f"le_{b}") for b in BOUNDS])


QUERIES = {f.__name__: f for f in (proc_archives, proc_email, proc_rtf, proc_pdf, match_pattern, url_pages, type_renames, store_metrics)}
_D = "FROM documents WHERE text IS NOT NULL AND text <> ''"
SQL = {
    "proc_archives": f"SELECT doc_id, (['TAR', 'ZIP', 'GZIP', 'BZIP2', 'XZ', 'Email'])[CAST(doc_id % 6 AS INTEGER) + 1] AS kind, md5(text) AS md5, 'us' AS handed_down {_D}",
    "proc_email": f"SELECT doc_id, 'Grüße ' || doc_id AS subject, 'a' || doc_id || '@x.example' AS sender, CAST(1 AS BIGINT) AS n_attachments, CAST(1593597600 AS BIGINT) AS date_ts {_D}",
    "proc_rtf": rf"SELECT doc_id, md5(x) AS md5 FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[\x00-\x08\x0b-\x1f]', '', 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS x {_D}) WHERE x <> ''",
    "proc_pdf": rf"SELECT * FROM (SELECT doc_id, CAST(strlen(trim(regexp_replace(text, '\n+', chr(10), 'g'), chr(10) || ' ' || chr(9) || chr(13))) AS BIGINT) AS size {_D} AND regexp_full_match(text, '[\x00-\x7F]*')) WHERE size > 0",
    "match_pattern": rf"SELECT doc_id {_D} AND (contains(text, 'review.') OR (starts_with(text, 'The ') AND strlen(text) >= 6 AND ascii(substr(text, 6, 1)) BETWEEN 96 AND 111 AND ascii(substr(text, 5, 1)) < 128) OR regexp_matches(text, '(?s)mon.*fr[\x00-\x7F]day'))",
    "url_pages": f"SELECT doc_id, md5(text) AS md5 {_D} AND doc_id % 3 <> 0",
    "type_renames": "SELECT coalesce(map {'Lnk': 'LNK', 'Pdf': 'PDF', 'Rar': 'RAR', 'Url': 'URL', 'Zip': 'ZIP'}[object_type], object_type) AS object_type, count(*) AS n FROM (SELECT DISTINCT id, object_type FROM objects) GROUP BY 1",
    "store_metrics": "WITH o AS (SELECT DISTINCT id, object_type, size, result FROM objects), p AS (SELECT *, CAST(CAST(result AS JSON)->>'$.ok.object_metadata._perf' AS DOUBLE) AS s FROM o) SELECT object_type, count(*) AS objects, count(*) FILTER (CAST(result AS JSON)->>'$.error' IS NOT NULL) AS errors, CAST(sum(size) AS BIGINT) AS bytes, count(s) AS timed, "
                     + ", ".join(f"count(*) FILTER (s <= {b}) AS le_{b}" for b in BOUNDS) + " FROM p GROUP BY object_type",
}
