"""Session-level helpers: table access and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; columns and filters applied by the caller reach the parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where it is unset (local tests) a folder of our own."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if have:
        return have
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="nestlake-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, *metrics: Column, rebalance: bool = True, into: str | None = None) -> DataFrame | tuple[DataFrame, dict]:
    """Write df as a parquet table in the shared folder and read it back: lineage ends, a lost executor loses nothing,
    and later joins know the true size (so Spark broadcasts it only below its own threshold).

    ``metrics`` are aggregates observed while writing: with any given, (table, {alias: value}) is returned, which
    saves the job that would count them. ``rebalance`` lets AQE merge small and split large output partitions first.
    ``into``: a folder from ``fresh_dir`` that the table becomes a part of; ``gathered`` reads all its parts as one.
    """
    spark = df.sparkSession
    path = f"{into}/{uuid.uuid4().hex}" if into else fresh_dir(spark)
    out, seen = df.hint("rebalance") if rebalance else df, Observation()
    if metrics:
        out = out.observe(seen, *metrics)
    out.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return (back, seen.get) if metrics else back


def fresh_dir(spark: SparkSession) -> str:
    """A new name in the shared folder; what is written there is deleted when the process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/nestlake-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def gathered(like: DataFrame, folder: str) -> DataFrame:
    """All parts that were cut into a folder, as one scan."""
    return like.sparkSession.read.schema(like.schema).option("recursiveFileLookup", "true").parquet(folder)


_written: list[tuple[SparkSession, str]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that cut() writes inside the block are deleted at its end; results must be written or collected before."""
    held = len(_written)
    try:
        yield
    finally:
        clean(held)


@atexit.register
def clean(keep: int = 0) -> None:
    """Delete the tables that cut() wrote in this process, but for the first ``keep``, as far as the session still runs."""
    while len(_written) > keep:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone; the cluster's own retention applies
            return
