"""Problem 1 over documents, codepage_strings and the volume labels of lnk_files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestlake.llm import mojibake as M
from nestlake.operators.nested import as_object
from nestlake.runtime import cut, table


def _labels(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("result")
    for m in ("ok", "object_metadata", "link_info", "volume_id"):
        v = as_object(F.try_variant_get(v, f"$.{m}", "variant"))
    return table(spark, d, "lnk_files").where(F.col("result").contains("volume_label")).select("lnk_id", v.alias("v")).where("v IS NOT NULL").select(
        F.lit("lnk_files").alias("src"), F.col("lnk_id").alias("rec_id"), F.try_variant_get("v", "$.volume_label", "string").alias("text"),
        F.try_variant_get("v", "$.volume_label_codepage", "string").alias("declared"))


def _damaged(spark: SparkSession, d: str) -> DataFrame:
    """Records sent again are decoded once; the declared encoding is fetched for the few suspicious documents only."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    strings = table(spark, d, "codepage_strings").select("str_id", "str_value", F.col("codepage").cast("string").alias("declared"))
    labels = cut(_labels(spark, d))
    lp = M.train(docs.select("text").unionAll(strings.select("str_value")).unionAll(labels.select("text")))
    odd = M.only_suspicious(docs, lp)
    said = table(spark, d, "text_metadata").groupBy("doc_id").agg(F.max("encoding").alias("declared"))
    docs = odd.join(said, "doc_id", "left").select(F.lit("documents").alias("src"), F.col("doc_id").alias("rec_id"), "text", "declared")
    strings = M.only_suspicious(strings.select(F.lit("codepage_strings").alias("src"), F.col("str_id").alias("rec_id"), F.col("str_value").alias("text"), "declared"), lp)
    rest = strings.unionByName(M.only_suspicious(labels, lp))
    once = rest.groupBy("src", "rec_id", "text").agg(F.max("declared").alias("declared"))
    return M.find(docs.unionByName(once), lp)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _damaged(spark, d).select("src", "rec_id").distinct()


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    """Damaged records with the text restored as far as possible, and the states that were undone."""
    return _damaged(spark, d)


QUERIES = {"p1_found": p1_found, "p1_restored": p1_restored}
SQL: dict[str, str] = {}
