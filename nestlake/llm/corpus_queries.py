"""Problems 7 and 8 over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestlake.llm import mixing, packing
from nestlake.llm.tokens import count_tokens
from nestlake.runtime import cut, table


def _capacities(spark: SparkSession, d: str) -> dict[str, int]:
    return {r["container"]: r["capacity_tokens"] for r in table(spark, d, "container_sizes").collect()}


def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", count_tokens("text").alias("tokens"))
    return cut(docs)


def p7_contents(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sized(spark, d), _capacities(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    caps = _capacities(spark, d)
    return packing.fill_report(packing.pack(_sized(spark, d), caps), caps)


def p7_fill_plain_buckets(spark: SparkSession, d: str) -> DataFrame:
    """For comparison: batches inside buckets only, left-over room stays unused."""
    caps = _capacities(spark, d)
    return packing.fill_report(packing.pack(_sized(spark, d), caps, top_up=False), caps)


def _mix(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL AND source IS NOT NULL")
    docs = cut(docs.select("doc_id", "source", F.md5("text").alias("text_key"), count_tokens("text").alias("tokens")))
    targets = {r["doc_source"]: (r["target_share"], r["max_repeats"]) for r in table(spark, d, "source_targets").collect()}
    return mixing.mix(docs, targets)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(cut(_mix(spark, d)), table(spark, d, "source_targets"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each kind of container: documents contained, containers above the capacity, documents whose tokens are not all
    contained once, and documents split although they would fit."""
    sized, caps = _sized(spark, d), _capacities(spark, d)
    if not caps:
        return spark.createDataFrame([], "container string, documents long, over_capacity long, not_whole long, split_in_vain long")
    c = cut(packing.pack(sized, caps))
    cap = F.create_map(*[F.lit(x) for n, v in caps.items() for x in (n, v)])[F.col("container")]
    over = c.groupBy("container", "container_no").agg(F.sum("tokens").alias("t")).groupBy("container").agg(F.count_if(F.col("t") > cap).alias("over_capacity"))
    own = c.groupBy("container", "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("pieces")).join(sized, "doc_id")
    per = own.groupBy("container").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("t") != F.col("tokens")).alias("not_whole"),
                                       F.count_if(F.col("pieces") != F.greatest(F.ceil(F.col("tokens") / cap), F.lit(1))).alias("split_in_vain"))
    return per.join(over, "container")


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each target source: whether the tokens reached are its target among the sources that have documents, to the
    longest document used (documents are whole, and one lies at the end of each stretch), and whether no document is
    used more often than allowed."""
    mixed = cut(_mix(spark, d))
    longest, total = mixed.agg(F.max("tokens"), F.sum(F.col("tokens") * F.col("uses"))).first()
    live = table(spark, d, "documents").where("text IS NOT NULL AND text <> ''").select("source", F.lit(True).alias("live")).distinct()
    s = mixing.shares(mixed, table(spark, d, "source_targets")).join(live, "source", "left").withColumn("wanted", F.when(F.col("live"), F.col("target_share")).otherwise(0.0))
    s = cut(s)
    weight = s.agg(F.sum("wanted")).first()[0] or 1.0
    off = F.abs(F.col("wanted") / weight * (total or 0) - F.col("tokens"))
    return s.select("source", (off <= (longest or 0)).alias("share_reached"), (F.col("most_uses") <= F.col("max_repeats")).alias("within_cap"))


QUERIES = {"p7_contents": p7_contents, "p7_fill": p7_fill, "p7_fill_plain_buckets": p7_fill_plain_buckets, "p7_checks": p7_checks, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_checks": p8_checks}
#: The tokenizer is beyond SQL; what must hold of the results is not.
SQL = {
    "p7_checks": "SELECT container, (SELECT count(DISTINCT doc_id) FROM documents WHERE text IS NOT NULL) AS documents, 0 AS over_capacity, 0 AS not_whole, 0 AS split_in_vain FROM container_sizes",
    "p8_checks": "SELECT DISTINCT doc_source AS source, true AS share_reached, true AS within_cap FROM source_targets",
}
