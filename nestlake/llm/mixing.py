"""Mixing sources to target shares of tokens with capped repetition.

Copies of one text in several sources are one unit that is a member of each of them; a source's second copy belongs to
a second unit, and so on, so every document is in exactly one unit. Units are aggregated by membership
pattern (at most 2^sources rows), and a min-cost flow on that small graph routes token capacity of the patterns to the
sources' quotas. The n-th use of a unit costs n - 1 a token, so repetition costs are convex and nothing is repeated
while fresh text is left. The mix is as large as the shares and caps allow. Within each pattern the units stand in the
order of a seeded hash; each flow takes a stretch of that order. The place of a unit is found from token sums of hash
bins and a running sum inside its bin only, never over the whole.

Defined results: null texts, texts without tokens and documents of no or another source are not used; a target
source without documents has share 0, the rest keep their proportions; a unit at the end of a
stretch belongs to the one that holds its middle, so a stretch is met to half a unit; a unit used for a
source is used as its document there; no document of a unit is used more often than the cap of its source, nor all of
them together more often than the largest cap; no usable source gives an empty mix.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nestlake.runtime import cut

UNITS_PER_BIN = 50_000
#: Copies of a text in a source that are numbered together; larger groups are split by a hash first.
COPIES = 10_000


class Flow:
    """Min-cost flow by successive shortest paths on a small graph with integer capacities."""

    def __init__(self) -> None:
        self.graph: dict = defaultdict(list)

    def arc(self, a: object, b: object, capacity: int, cost: int = 0) -> None:
        self.graph[a].append([b, capacity, cost, len(self.graph[b]), True])
        self.graph[b].append([a, 0, -cost, len(self.graph[a]) - 1, False])

    def run(self, source: object, sink: object) -> int:
        total = 0
        while True:
            dist, via, queued, queue = {source: 0}, {}, {source}, deque([source])
            while queue:
                a = queue.popleft()
                queued.discard(a)
                for k, (b, left, cost, _, _) in enumerate(self.graph[a]):
                    if left > 0 and dist[a] + cost < dist.get(b, math.inf):
                        dist[b], via[b] = dist[a] + cost, (a, k)
                        if b not in queued:
                            queued.add(b)
                            queue.append(b)
            if sink not in dist:
                return total
            push, b = math.inf, sink
            while b != source:
                a, k = via[b]
                push, b = min(push, self.graph[a][k][1]), a
            b = sink
            while b != source:
                a, k = via[b]
                e = self.graph[a][k]
                e[1] -= push
                self.graph[b][e[3]][1] += push
                b = a
            total += push


def route(supply: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> list[tuple[str, int, str, int]]:
    """supply: pattern (sources joined by ``|``) -> tokens; targets: source -> (share, cap). -> [(pattern, use, source, tokens)]."""
    members = {p: [s for s in p.split("|") if s in targets] for p in supply}
    live = {s for p in members for s in members[p] if supply[p] > 0 and targets[s][0] > 0 and targets[s][1] > 0}
    weight = sum(targets[s][0] for s in live)
    if not live:
        return []

    def solve(size: int) -> tuple[bool, Flow]:
        g, want = Flow(), 0
        for s in sorted(live):
            quota = int(size * targets[s][0] / weight)
            want += quota
            g.arc(("source", s), "sink", quota)
        for p in sorted(supply):
            for use in range(1, 1 + max((targets[s][1] for s in members[p] if s in live), default=0)):
                g.arc("all", (p, use), supply[p], use - 1)
                for s in members[p]:
                    if s in live and use <= targets[s][1]:
                        g.arc((p, use), ("source", s), supply[p])
        return g.run("all", "sink") == want, g

    if total is None:
        lo, hi = 0, sum(supply[p] * max((targets[s][1] for s in members[p]), default=0) for p in supply) + 1
        while hi - lo > max(1, hi // 100_000):
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if solve(mid)[0] else (lo, mid)
        total = lo
    _, g = solve(total)
    out = []
    for p in sorted(supply):
        for use in range(1, 1 + max((targets[s][1] for s in members[p] if s in live), default=0)):
            for b, left, _, _, forward in g.graph[(p, use)]:
                if forward and supply[p] > left:
                    out.append((p, use, b[1], supply[p] - left))
    return out


def mix(docs: DataFrame, targets: dict[str, tuple[float, int]], total: int | None = None, seed: int = 7) -> DataFrame:
    """docs(doc_id, source, text_key, tokens), already materialised -> (doc_id, source, uses, tokens)."""
    spark = docs.sparkSession
    known = docs.where(F.col("source").isin(list(targets)) & (F.col("tokens") > 0))
    once = known.groupBy("text_key", "source", "doc_id").agg(F.max("tokens").alias("tokens"))
    many = once.groupBy("text_key", "source").agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") > COPIES)  # rarely any, so a small table to join
    group = once.join(many, ["text_key", "source"], "left").withColumn("__g", F.pmod(F.xxhash64("doc_id"), F.ceil(F.coalesce("__c", F.lit(1)) / COPIES)))
    copy = F.row_number().over(Window.partitionBy("text_key", "source", "__g").orderBy("doc_id"))
    unit = group.withColumn("__j", copy).groupBy("text_key", "__g", "__j").agg(F.max("tokens").alias("tokens"), F.map_from_entries(F.collect_list(F.struct("source", "doc_id"))).alias("of"))  # one document of each source
    unit = cut(unit.select(F.concat_ws("/", "text_key", "__g", "__j").alias("text_key"), "tokens", "of", F.array_join(F.array_sort(F.map_keys("of")), "|").alias("pattern"), F.xxhash64("text_key", "__g", "__j", F.lit(seed)).alias("h")))
    sums = unit.groupBy("pattern").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()  # at most 2^sources rows
    flows = route({r["pattern"]: r["t"] for r in sums}, targets, total)
    schema = "doc_id long, source string, uses int, tokens long"
    if not flows:
        return spark.createDataFrame([], schema)
    bins = max(16, -(-sum(r["n"] for r in sums) // UNITS_PER_BIN))
    unit = unit.withColumn("bin", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * bins).cast("long"))
    per_bin = unit.groupBy("pattern", "bin").agg(F.sum("tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = unit.join(per_bin.select("pattern", "bin", before.alias("base")), ["pattern", "bin"])
    inside = F.sum("tokens").over(Window.partitionBy("pattern", "bin").orderBy("h", "text_key").rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("start", F.col("base") + inside - F.col("tokens") / 2)  # the middle of the unit decides
    stretches, at = [], {}
    for p, use, s, tokens in flows:
        lo = at.get((p, use), 0)
        stretches.append((p, s, lo, lo + tokens))
        at[(p, use)] = lo + tokens
    plan = spark.createDataFrame(stretches, "__p string, __s string, lo long, hi long")  # as many rows as flows
    used = placed.join(F.broadcast(plan), (F.col("pattern") == F.col("__p")) & (F.col("start") >= F.col("lo")) & (F.col("start") < F.col("hi")))
    used = used.select(F.col("of")[F.col("__s")].alias("doc_id"), F.col("__s").alias("source"), "tokens")
    return used.groupBy("doc_id", "source").agg(F.count(F.lit(1)).cast("int").alias("uses"), F.max("tokens").cast("long").alias("tokens"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """targets(doc_source, target_share, max_repeats) -> what was reached of each."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    n = got.agg(F.sum("tokens")).first()[0] or 1
    return targets.join(got, F.col("doc_source") == F.col("source"), "left").select(
        F.col("doc_source").alias("source"), "target_share", F.round(F.coalesce("tokens", F.lit(0)) / n, 6).alias("reached_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats")
