"""Sums along one global order, without one task that sees it all."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nestlake.runtime import cut


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, under each name, the sum of its column over all rows up to and including the own one in the order.

    Rows are range-partitioned by the whole order, so rows that share its first key are split as well, as long as the
    order tells them apart; each partition is summed on its own and shifted by the totals of those before it (one row
    per partition comes to the driver). Rows that the order does not tell apart stand in any order. Nulls sum as 0.
    """
    n = range(len(sums))
    x = df.select("*", *[F.coalesce(c, F.lit(0)).cast("long").alias(f"__v{k}") for k, c in enumerate(sums.values())])
    x = cut(x.repartitionByRange(*order).select("*", F.spark_partition_id().alias("__p")), rebalance=False)
    totals = {r["__p"]: r for r in x.groupBy("__p").agg(*[F.sum(f"__v{k}").alias(f"t{k}") for k in n]).collect()}
    parts = sorted(totals)
    before = [[0, *accumulate(totals[p][f"t{k}"] for p in parts)] for k in n]
    shifts = [F.create_map(*[F.lit(y) for j, p in enumerate(parts) for y in (p, before[k][j])]) if parts else F.create_map(F.lit(0), F.lit(0)) for k in n]
    inside = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return x.select(*df.columns, *[(F.sum(f"__v{k}").over(inside) + shifts[k][F.col("__p")]).cast("long").alias(name) for k, name in enumerate(sums)])


def window_sums(points: DataFrame, entries: DataFrame, width: int, sums: dict[str, Column]) -> DataFrame:
    """points(key, at), key unique; entries(at, id, ...): for each point the sums over the entries with at - width <= at
    <= at + width, as differences of running sums at both ends: linear, whatever the width and however many share a moment."""
    ends = F.array(*[F.struct((F.col("at") + d * width).alias("at"), F.lit(kind).alias("__kind")) for d, kind in ((-1, 0), (1, 2))])
    line = points.select("key", F.explode(ends).alias("p")).select("key", "p.*")  # an entry lies behind a lower end at its moment, before an upper one
    line = line.unionByName(entries.select("at", "id", F.lit(1).alias("__kind"), *[c.alias(n) for n, c in sums.items()]), allowMissingColumns=True)
    line = running_sums(line.withColumnsRenamed({n: f"__s_{n}" for n in sums}), [F.col("at"), F.col("__kind"), F.col("id"), F.col("key")], {n: F.col(f"__s_{n}") for n in sums})
    return line.where(F.col("__kind") != 1).groupBy("key").agg(*[(F.max(F.when(F.col("__kind") == 2, F.col(n))) - F.max(F.when(F.col("__kind") == 0, F.col(n)))).alias(n) for n in sums])
