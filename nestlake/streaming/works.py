"""Streams: dissection of arriving content, scenarios on completed works, windowed counts of events.

Each micro-batch is an ordinary batch job over its rows and the stored tables. Outputs are written under the batch's
number and overwrite a former attempt, so a batch that is run again after a failure leaves one result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nestlake.operators.ingest import dissect
from nestlake.plans.compiler import Nodes
from nestlake.plans.scenarios import Scenario, evaluate
from nestlake.plans.search import Store


def dissect_stream(submissions: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """submissions as for dissect; writes {out}/objects/batch=n and {out}/rels/batch=n."""

    def batch(df: DataFrame, n: int) -> None:
        objects, rels = dissect(df)
        objects.write.mode("overwrite").parquet(f"{out}/objects/batch={n}")
        rels.write.mode("overwrite").parquet(f"{out}/rels/batch={n}")

    return submissions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def scenario_stream(completed: DataFrame, tables: Callable[[], tuple[DataFrame, DataFrame]], scenarios: Callable[[], list[Scenario]], out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """completed(work_id): works that are in the stored tables now. Tables and scenarios are read anew in each batch, as
    a reload would; a work is looked at with the neighbours stored by then, and again when it is sent again."""

    def batch(df: DataFrame, n: int) -> None:
        objects, rels = tables()
        fired = evaluate(Store(Nodes(objects, rels)), scenarios(), df.select("work_id").distinct())
        fired.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return completed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """events(ts timestamp, event_type, value): counts and sums of each window; rows later than ``late`` are dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
