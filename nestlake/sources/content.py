"""Content tables: files as rows, type detection by leading bytes, hashes and entropy."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values: (type, offset, leading bytes); the first that holds decides.
MAGIC = (
    ("PDF", 0, b"%PDF-"), ("RTF", 0, b"{\\rtf"), ("7Z", 0, b"7z\xbc\xaf\x27\x1c"), ("RAR", 0, b"Rar!\x1a\x07"), ("GZIP", 0, b"\x1f\x8b"), ("BZIP2", 0, b"BZh"), ("XZ", 0, b"\xfd7zXZ\x00"),
    ("CAB", 0, b"MSCF"), ("ARJ", 0, b"\x60\xea"), ("ELF", 0, b"\x7fELF"), ("Image", 0, b"\x89PNG\r\n\x1a\n"), ("Image", 0, b"GIF8"), ("Image", 0, b"\xff\xd8\xff"), ("Image", 0, b"BM"),
    ("LNK", 0, b"L\x00\x00\x00\x01\x14\x02\x00"), ("MachO", 0, b"\xcf\xfa\xed\xfe"), ("MachO", 0, b"\xce\xfa\xed\xfe"), ("MachO", 0, b"\xfe\xed\xfa\xcf"), ("MachO", 0, b"\xfe\xed\xfa\xce"),
    ("TAR", 257, b"ustar"), ("CDFS", 32769, b"CD001"),
)
# Older spellings of types and the ones used here.
ALIASES = {"Lnk": "LNK", "Pdf": "PDF", "Rar": "RAR", "Url": "URL", "Zip": "ZIP"}


# Header names that show a mail.
_MAIL_HEADERS = (b"from", b"to", b"subject", b"date", b"received", b"message-id", b"mime-version", b"return-path", b"content-type")
_HTML, _SVG = re.compile(rb"<(?:html|body)[\s>]|^\s*<!doctype html", re.I), re.compile(rb"<svg[\s>]", re.I)


def detect(content: bytes | None) -> str:
    if content is None:
        return "SKIPPED"
    if not content:
        return "EMPTY"
    for kind, at, magic in MAGIC:
        if content[at:at + len(magic)] == magic:
            return kind
    if content[:2] == b"MZ":
        at = int.from_bytes(content[0x3C:0x40], "little")
        return "PE" if content[at:at + 4] == b"PE\0\0" else "DOS"
    if content[:4] == b"\xca\xfe\xba\xbe" and 0 < int.from_bytes(content[4:8], "big") < 43:
        return "UniversalBinary"
    if content[:4] == b"PK\x03\x04":
        head = content[:4096]
        if b"mimetypeapplication/vnd.oasis.opendocument" in head:
            return "ODF"
        if b"[Content_Types].xml" in content and any(x in content for x in (b"word/", b"xl/", b"ppt/")):
            return "Office"
        return "ZIP"
    if content[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        wide = lambda s: s.encode("utf-16-le")
        return "MSG" if wide("__substg1.0_") in content else "MSI" if wide("䡀") in content else "Office"
    lines = re.split(rb"\r?\n\r?\n", content, maxsplit=1)[0].split(b"\n")  # the header ends at the first empty line
    if sum(x.split(b":")[0].lower() in _MAIL_HEADERS for x in lines) >= 2:
        return "Email"  # before HTML, which a mail may hold
    if _HTML.search(content):
        return "HTML"
    start = content.lstrip()[:5].lower()
    if start in (b"<svg ", b"<?xml", b"<svg>") and _SVG.search(content):
        return "Image"
    return "Text" if _is_text(content) else "UNKNOWN"


def _is_text(content: bytes) -> bool:
    """Up to four chunks of 512 bytes without control characters, and most of it letters, digits and blanks."""
    step = max(len(content) // 4, 512)
    for at in range(0, min(len(content), 4 * step), step):
        chunk = content[at:at + 512]
        if any(b < 9 or 13 < b < 32 and b != 27 for b in chunk):
            return False
    return True


@F.pandas_udf(T.StringType())
def detect_type(content: pd.Series) -> pd.Series:
    return content.map(detect)


@F.pandas_udf(T.DoubleType())
def entropy(content: pd.Series) -> pd.Series:
    """Shannon entropy of the bytes in bits; 0 for nothing."""

    def one(c: bytes | None) -> float | None:
        if c is None:
            return None
        n = np.bincount(np.frombuffer(c, np.uint8), minlength=256)
        p = n[n > 0] / max(len(c), 1)
        return float(-(p * np.log2(p)).sum()) + 0.0 if len(c) else 0.0

    return content.map(one)


def hashes(content: str) -> Column:
    c = F.col(content)
    return F.create_map(F.lit("md5"), F.md5(c), F.lit("sha1"), F.sha1(c), F.lit("sha256"), F.sha2(c, 256), F.lit("sha512"), F.sha2(c, 512))


def read_files(spark: SparkSession, path: str, org: str = "default") -> DataFrame:
    """Submissions from files: (work_id, org, t, content, props)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return f.where("length > 0").select(F.sha2(F.col("path"), 256).alias("work_id"), F.lit(org).alias("org"), F.col("modificationTime").alias("t"), "content", F.to_json(F.struct(name.alias("name"))).alias("props"))


def read_object(contents: DataFrame, object_id: str) -> DataFrame:
    """Content of one object by its id, the SHA-256 of the content. Where the table stores the ids, the filter reaches
    the scan; only else every content has to be hashed."""
    own = F.col("object_id") if "object_id" in contents.columns else F.sha2("content", 256)
    return contents.where(own == object_id).select("content").limit(1)


def rename_types(objects: DataFrame) -> DataFrame:
    """Rows stored under older spellings of types, brought up to date."""
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return objects.withColumn("object_type", F.coalesce(names[F.col("object_type")], F.col("object_type")))
