"""Filling containers of fixed capacity with texts of varying length.

Lengths above the capacity are cut into pieces of exactly the capacity, each a full container, and a rest. The global
histogram of item lengths (at most capacity + 1 entries) goes to the driver, where dynamic programming places the
bucket boundaries, over all lengths, so that padding every item to its bucket's boundary wastes least. Token-budget batches form bucket by
bucket from the longest: a container is filled with the longest items of the bucket that still fit. When a bucket is
done, what room its containers have left is topped up from the shorter buckets, least room first (``top_up=False``
leaves it, as plain buckets would; the README has the figures of both). Containers are made inside hash shards of some ``SHARD_ITEMS`` items, so work and
memory of a task stay bounded at any size and no order over all items is needed.

Defined results: null texts are no items; an empty text is an item of 0 tokens; a capacity below 1 is an error;
no capacity gives no containers; equal items are told apart by doc_id and piece; the result is the same for the same input rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_ITEMS = 20_000
BUCKETS = 12


def pieces(sized: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """sized(doc_id, tokens) -> (container, capacity, doc_id, piece, first_token, tokens) for every capacity."""
    if any(c < 1 for c in capacities.values()):
        raise ValueError("a capacity must be at least 1")
    caps = F.explode(F.array(*[F.struct(F.lit(n).alias("container"), F.lit(c).alias("capacity")) for n, c in sorted(capacities.items())]))
    x = sized.select("doc_id", F.col("tokens").alias("__t"), caps.alias("c")).select("c.*", "doc_id", "__t")
    last = F.greatest(F.ceil(F.col("__t") / F.col("capacity")).cast("int") - 1, F.lit(0))
    x = x.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    first = F.col("piece") * F.col("capacity")
    return x.select("container", "capacity", "doc_id", "piece", first.alias("first_token"), F.least(F.col("__t") - first, F.col("capacity")).alias("tokens"))


def boundaries(lengths: Sequence[int], counts: Sequence[int], k: int = BUCKETS) -> list[int]:
    """At most k upper bounds, the last the longest length, with the least total padding up to them."""
    order = np.argsort(lengths)
    x, n = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.float64)[order]
    if not len(x):
        return []
    cum_n, cum_s = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * x)])
    up = np.concatenate([[0], x])
    m = len(up)
    best = np.full(m, np.inf)
    best[0] = 0
    back = []
    for _ in range(min(k, m - 1)):
        now, cut = np.full(m, np.inf), np.zeros(m, np.int64)
        # The best last cut never moves back as the end moves on, so the middle end's cut bounds those on either side.
        spans = [(1, m - 1, 0, m - 2)]
        while spans:
            lo, hi, first, last = spans.pop()
            e = (lo + hi) // 2
            a, b = first, min(last, e - 1) + 1
            cost = best[a:b] + up[e] * (cum_n[e] - cum_n[a:b]) - (cum_s[e] - cum_s[a:b])
            j = a + int(cost.argmin())
            now[e], cut[e] = cost[j - a], j
            if lo < e:
                spans.append((lo, e - 1, first, j))
            if e < hi:
                spans.append((e + 1, hi, j, last))
        now[0] = 0
        back.append((now, cut))
        best = now
    level = min(range(len(back)), key=lambda b: (back[b][0][m - 1], b))
    out, e = [], m - 1
    while e > 0 and level >= 0:
        out.append(int(up[e]))
        e = int(back[level][1][e])
        level -= 1
    return sorted(set(out))


def fill(sizes: np.ndarray, bucket: np.ndarray, capacity: int, top_up: bool = True) -> np.ndarray:
    """Container number of each item. Bucket by bucket from the longest: first all containers of a bucket, each with the
    longest of its items that still fit, then what room they have left, least room first, from the shorter buckets."""
    by_length: dict[tuple[int, int], list[int]] = {}
    for k in np.lexsort((np.arange(len(sizes)), sizes))[::-1]:
        by_length.setdefault((int(bucket[k]), int(sizes[k])), []).append(int(k))
    keys = sorted(by_length)  # boundaries are upper bounds of lengths, so lengths are in order as well
    out, number = np.zeros(len(sizes), np.int64), 0

    def take(room: int, least: int, below: int) -> int:
        """Put the longest fitting items of the buckets from ``least`` to under ``below`` into the container; room left."""
        while True:
            p = min(bisect_right(lengths, room), bisect_left(keys, (below, -1))) - 1
            if p < 0 or keys[p][0] < least:
                return room
            own = by_length[keys[p]]
            out[own.pop()] = number_of
            room -= keys[p][1]
            if not own:
                keys.pop(p)
                lengths.pop(p)

    lengths = [length for _, length in keys]
    while keys:
        b, rooms = keys[-1][0], []
        while keys and keys[-1][0] == b:
            number_of = number
            rooms.append((take(capacity, b, b + 1), number))
            number += 1
        for room, number_of in sorted(rooms) if top_up else ():
            take(room, -1, b)
    return out


def pack(sized: DataFrame, capacities: dict[str, int], top_up: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """sized(doc_id, tokens), already materialised -> the contents of each container:
    (container, container_no, slot, doc_id, piece, first_token, tokens, bucket)."""
    schema = "container string, container_no string, slot int, doc_id long, piece int, first_token int, tokens int, bucket int"
    if not capacities:
        return sized.sparkSession.createDataFrame([], schema)
    items = pieces(sized, capacities)
    hist = items.groupBy("container", "capacity", "tokens").count().collect()  # at most the capacities' sum of rows
    bounds, shards = {}, {}
    for name in capacities:
        own = [(r["tokens"], r["count"]) for r in hist if r["container"] == name and r["tokens"] < r["capacity"]]
        bounds[name] = boundaries([a for a, _ in own], [b for _, b in own], buckets)
        shards[name] = max(1, -(-sum(b for _, b in own) // SHARD_ITEMS))
    shard_of = F.create_map(*[F.lit(x) for n, s in shards.items() for x in (n, s)])[F.col("container")]
    full = F.col("tokens") == F.col("capacity")
    spread = F.pmod(F.xxhash64("doc_id", "piece"), shard_of.cast("long"))
    items = items.withColumn("__shard", spread)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name, shard = key
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], kind="stable", ignore_index=True)
        at = np.searchsorted(np.array(bounds[name]), pdf["tokens"])
        no = fill(pdf["tokens"].to_numpy(), at, int(pdf["capacity"].iloc[0]), top_up) if len(pdf) else np.zeros(0, int)
        out = pdf.assign(bucket=at.astype("int32"), container_no=[f"{shard}-{x}" for x in no])
        out["slot"] = out.sort_values(["tokens", "doc_id"], ascending=[False, True]).groupby("container_no").cumcount().astype("int32")
        return out[["container", "container_no", "slot", "doc_id", "piece", "first_token", "tokens", "bucket"]]

    packed = items.where(~full).groupBy("container", "__shard").applyInPandas(run, schema)
    alone = items.where(full).select("container", F.format_string("f-%d-%d", "doc_id", "piece").alias("container_no"), F.lit(0).alias("slot"),
                                     "doc_id", "piece", F.col("first_token").cast("int").alias("first_token"), F.col("tokens").cast("int").alias("tokens"), F.lit(buckets).alias("bucket"))
    return packed.unionByName(alone)


def fill_report(contents: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """(container, containers, items, tokens, room, fill)."""
    if not capacities:
        return contents.sparkSession.createDataFrame([], "container string, containers long, items long, tokens long, room long, fill double")
    per = contents.groupBy("container", "container_no").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    cap = F.create_map(*[F.lit(x) for n, c in capacities.items() for x in (n, c)])[F.col("container")]
    return per.groupBy("container").agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens")).select(
        "*", (F.col("containers") * cap).alias("room"), F.round(F.col("tokens") / (F.col("containers") * cap), 4).alias("fill"))
