"""Problem 6 over documents and text_metadata."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestlake.llm import langid
from nestlake.runtime import table


#: The languages of these tables.
LANGUAGES = ["de", "en", "es", "fr", "it", "pl", "ru"]


@F.pandas_udf(T.StringType())
def _named(label: pd.Series) -> pd.Series:
    known = {x: langid.named(x) for x in label.dropna().unique()}
    return label.map(known).where(label.notna(), None).astype(object).where(lambda s: s.notna(), None)


def p6_labels(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every document, or of every paragraph of a mixed one."""
    docs = table(spark, d, "documents")
    return langid.label_documents(docs, langid.train(docs.select("text", "lang"), LANGUAGES))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = p6_labels(spark, d).select("doc_id", "para", F.col("lang").alias("true_lang"))
    own = table(spark, d, "documents").select("doc_id", _named("lang").alias("said"))
    meta = table(spark, d, "text_metadata").groupBy("doc_id").agg(F.max("natural_language").alias("nl")).select("doc_id", _named("nl").alias("meta_said"))
    joined = found.join(own, "doc_id").join(meta, "doc_id", "left")
    agree = F.col("said").eqNullSafe(F.col("true_lang")) & F.col("meta_said").eqNullSafe(F.col("true_lang"))
    return joined.where((F.col("para") >= 0) | ~agree).select("doc_id", "para", F.col("true_lang").alias("lang")).distinct()


def p6_covered(spark: SparkSession, d: str) -> DataFrame:
    """Documents that get a language: all with enough letters, and paragraphs of mixed ones numbered without a gap."""
    per = p6_labels(spark, d).distinct().groupBy("doc_id").agg(F.min("para").alias("first"), F.max("para").alias("last"), F.count(F.lit(1)).alias("n"), F.min("confidence").alias("lo"), F.max("confidence").alias("hi"))
    return per.select("doc_id", ((F.col("last") - F.col("first") + 1 == F.col("n")) & (F.col("lo") >= 0) & (F.col("hi") <= 1)).alias("whole"))


QUERIES = {"p6_found": p6_found, "p6_labels": p6_labels, "p6_covered": p6_covered}
SQL = {"p6_covered": r"SELECT DISTINCT doc_id, true AS whole FROM documents WHERE length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 20"}
