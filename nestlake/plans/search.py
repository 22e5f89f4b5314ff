"""Entry points: search, count, global queries over neighbours, work graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestlake.operators import hierarchy
from nestlake.plans import ast as A
from nestlake.plans.compiler import Compiler, Nodes, shared
from nestlake.plans.parser import parse, parse_global

DEFAULT_LIMIT = 1000


class Store:
    """Nodes of all works, as stored tables or as rows already joined; ancestor pairs are made once when a query first
    needs them, and kept as long as the store. A store belongs to the state of its tables when it was made."""

    def __init__(self, nodes: Nodes | DataFrame, pattern_tag: str = "Pattern.", compat: bool = False) -> None:
        self.source = nodes if isinstance(nodes, Nodes) else Nodes(nodes)
        self.tag, self.compat = pattern_tag, compat
        self._closure: DataFrame | None = None

    @property
    def nodes(self) -> DataFrame:
        return self.source.rows()

    def closure(self) -> DataFrame:
        if self._closure is None:
            f = hierarchy.build_forest(self.source.objects.select(F.col("id").alias("node")), self.source.own_links().select("parent", "child"))
            self._closure = hierarchy.descendants(f).select(F.col("ancestor").alias("anc"), F.col("descendant").alias("desc"), F.col("distance").alias("depth"))
        return self._closure

    def compiler(self, q: A.Query, **more) -> Compiler:
        return Compiler(more.pop("base", self.source), self.closure, q.variables, pattern_tag=self.tag, compat=self.compat, **more)

    def matching(self, text: str) -> DataFrame:
        """All nodes that a query selects."""
        q = parse(text)
        return self.compiler(q).select(q.body)

    def search_objects(self, text: str, limit: int | None = None) -> DataFrame:
        """object_id of matching nodes, ordered before the limit so that it is the same each time."""
        return _limited(self.matching(text).select("work_id", "object_id"), limit, "work_id", "object_id")

    def search_works(self, text: str, limit: int | None = None) -> DataFrame:
        return _limited(self.matching(text).select("work_id").distinct(), limit, "work_id")

    def count(self, text: str) -> DataFrame:
        return self.matching(text).agg(F.count(F.lit(1)).alias("objects"), F.count_distinct("work_id").alias("works"))

    def explain(self, text: str) -> str:
        """The plan that a query becomes, for people who wonder what it costs."""
        df = self.matching(text)
        return df._jdf.queryExecution().toString()

    def selectors(self, q: A.Query, locals_: DataFrame | None = None) -> dict[str, DataFrame]:
        """(local, value) of each selector of a query, over the local works only."""
        base = self.source if locals_ is None else self.source.within(lambda x: x.join(locals_.select(F.col("local").alias("work_id")).distinct(), "work_id", "left_semi"))
        c = self.compiler(q, base=base)
        return {n: c.selector_values(v, "local") for n, v in q.variables.items() if isinstance(v, A.Selector)}

    def shared_values(self, q: A.Query, locals_: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        """(local, value) and (neighbour, value): the global query matches just the pairs that have a value in common. None
        where it asks for something else."""
        found = shared(q.body, {n for n, v in q.variables.items() if isinstance(v, A.Selector)})
        if found is None:
            return None
        test, name, rest = found
        own = self.selectors(q, locals_)[name].where("value IS NOT NULL")
        return own, self.compiler(q).held(test, rest).select(F.col("work_id").alias("neighbour"), "value")

    def global_matches(self, q: A.Query | str, pairs: DataFrame) -> DataFrame:
        """pairs(local, neighbour) -> those for which the neighbour has a node that the global query selects."""
        q = parse_global(q) if isinstance(q, str) else q
        pairs = pairs.select("local", F.col("neighbour").alias("work_id")).distinct()
        has_selector = any(isinstance(v, A.Selector) for v in q.variables.values())
        if not has_selector:  # the answer does not depend on the local work: ask each neighbour once
            base = self.source.within(lambda x: x.join(pairs.select("work_id").distinct(), "work_id", "left_semi"))
            works = self.compiler(q, base=base).select(q.body).select("work_id").distinct()
            return pairs.join(works, "work_id").select("local", F.col("work_id").alias("neighbour"))
        base = self.source.within(lambda x: x.join(pairs, "work_id"), "local")
        c = self.compiler(q, base=base, keys=("local", "work_id"), selectors=self.selectors(q, pairs))
        return c.select(q.body).select("local", F.col("work_id").alias("neighbour")).distinct()

    def work_graph(self, works: list[str] | DataFrame) -> DataFrame:
        """Rows of whole works in depth-first order of ids: what a caller needs to rebuild each tree."""
        keep = self.nodes.where(F.col("work_id").isin(works)) if isinstance(works, list) else self.nodes.join(works, "work_id", "left_semi")
        f = hierarchy.build_forest(keep.select(F.col("id").alias("node")), keep.select("parent", F.col("id").alias("child")))
        return keep.join(hierarchy.paths(f).select(F.col("node").alias("id"), "depth", "path"), "id").orderBy("work_id", "path")


def _limited(df: DataFrame, limit: int | None, *order: str) -> DataFrame:
    return df if limit is None else df.orderBy(*order).limit(limit or DEFAULT_LIMIT)
