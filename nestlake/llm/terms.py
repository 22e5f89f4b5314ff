"""Frequency of every distinct term: occurrences and records, with a mark on the too rare and the too common.

Heavy-light aggregation. A one-pass sketch over all rows finds the terms in more than one of ``HEAVY_ONE_IN`` rows (a
bounded list, broadcast). Rows of heavy terms carry the term's slot in its place; they are reduced to one row per
(record, slot), sums before each shuffle, and counted in exact local arrays, one vector of counters per task. Only the
rows of the remaining terms are shuffled by term, once: since no such term can be frequent, no task gets a hot key, and
repeated rows, records and occurrences are all told apart behind that one exchange. The two count tables are unioned.
The sketch only routes: every term is counted exactly, whichever way it goes.

Defined results: a null term or record is not counted; a row repeated with the same (record, item) counts once; the
empty term is a term; bands are ``rare`` (at most ``rare_max`` records), else ``common`` (more than ``common_share`` of
all distinct records, those without any term included), else null; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms expected in more than one of so many (record, term) rows are heavy; the broadcast list has at most twice as many entries.
HEAVY_ONE_IN = 2000


def _local_counts(n: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occ, rec = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for b in batches:
            slot, hits = b.column(0).to_numpy(), b.column(1).to_numpy()
            rec += np.bincount(slot, minlength=n)
            occ += np.bincount(slot, hits, n).astype(np.int64)
        used = np.nonzero(rec)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(occ[used]), pa.array(rec[used])], ["slot", "occurrences", "records"])

    return count


def term_counts(rows: DataFrame) -> DataFrame:
    """rows(record, item, term): one row per occurrence; equal rows are one. -> (term, occurrences, records)."""
    rows = rows.select("record", "item", "term").where(F.col("record").isNotNull() & F.col("term").isNotNull())
    k = 2 * HEAVY_ONE_IN
    top = rows.agg(F.expr(f"approx_top_k(term, {k}, {max(10 * k, 10000)})").alias("t"), F.count(F.lit(1)).alias("n")).first()
    heavy = [x["item"] for x in (top["t"] or []) if x["count"] * HEAVY_ONE_IN > top["n"]]
    if not heavy:
        return _light(rows)
    slots = F.broadcast(rows.sparkSession.createDataFrame(list(enumerate(heavy)), "slot int, term string"))  # at most k rows
    routed = rows.join(slots, "term", "left")
    once = routed.where("slot IS NOT NULL").select("record", "item", "slot").distinct()
    pairs = once.groupBy("record", "slot").agg(F.count(F.lit(1)).alias("hits")).select("slot", "hits")
    counted = pairs.mapInArrow(_local_counts(len(heavy)), "slot int, occurrences long, records long")
    sums = counted.groupBy("slot").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return sums.join(slots, "slot").select("term", "occurrences", "records").unionByName(_light(routed.where("slot IS NULL")))


def _light(rows: DataFrame) -> DataFrame:
    """Counts of terms none of which is frequent: all three groupings are served by one exchange by term."""
    once = rows.select("term", "record", "item").repartition("term").groupBy("term", "record", "item").agg(F.lit(1).alias("__one"))
    return once.groupBy("term", "record").agg(F.count(F.lit(1)).alias("hits")).groupBy("term").agg(F.sum("hits").alias("occurrences"), F.count(F.lit(1)).alias("records"))


def banded(counts: DataFrame, n_records: int, rare_max: int = 2, common_share: float = 0.1) -> DataFrame:
    """Adds ``band``; n_records is the number of distinct records of the whole table."""
    common = F.col("records") > F.lit(common_share) * F.lit(n_records)
    return counts.withColumn("band", F.when(F.col("records") <= rare_max, "rare").when(common, "common"))
