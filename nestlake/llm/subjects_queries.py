"""Problem 9 over documents, subjects and subject_labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestlake.llm import subjects as S
from nestlake.runtime import table


def p9_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of every document with their probability and the expected share of its sentences."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source", "lang")
    names = sorted(r[0] for r in table(spark, d, "subjects").where("subject IS NOT NULL").select("subject").distinct().collect())  # a fixed small table
    return S.label_documents(docs, table(spark, d, "subject_labels"), names)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_subjects(spark, d).select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Make-up of the corpus: documents of each subject and their share of all documents with text."""
    n = table(spark, d, "documents").where("text IS NOT NULL").count()
    return p9_subjects(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.round(F.count(F.lit(1)) / n, 6).alias("share"))


QUERIES = {"p9_found": p9_found, "p9_subjects": p9_subjects, "p9_composition": p9_composition}
SQL: dict[str, str] = {}
