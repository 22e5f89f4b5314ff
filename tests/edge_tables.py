"""Folders of tables without rows, and of rows that are null all over, for queries that must bear both."""

import os

SOURCE = "/root/testdata/sf0.001"


def empty(spark, out):
    for name in os.listdir(SOURCE):
        spark.read.parquet(f"{SOURCE}/{name}").limit(0).withColumn("extra", __import__("pyspark").sql.functions.lit(1)).write.parquet(f"{out}/{name}")
    return str(out)


def hollow(spark, out):
    """The first rows of each table, then the same rows again with every column but the first null, and a row of nulls."""
    from pyspark.sql import functions as F

    for name in os.listdir(SOURCE):
        t = spark.read.parquet(f"{SOURCE}/{name}")
        rows = t.orderBy(t.columns[0]).limit(40)
        key = t.columns[0]
        gone = rows.select(key, *[F.lit(None).cast(t.schema[c].dataType).alias(c) for c in t.columns[1:]])
        none = rows.limit(1).select(*[F.lit(None).cast(t.schema[c].dataType).alias(c) for c in t.columns])
        fixed = name.split(".")[0] in ("subjects", "container_sizes", "source_targets", "nation", "region")
        (t if fixed else rows.unionByName(gone).unionByName(none)).withColumn("depth", F.lit("clash")).coalesce(1).write.parquet(f"{out}/{name}")
    return str(out)
