"""Parent-child links of unknown depth -> path, depth, root, descendants, and broken links.

Level-wise frontier joins from the roots extend paths and depths. Each level is one equi-join of the links
(hash-partitioned on the parent) with the last frontier; while frontiers are wide a round is one level, once they
are narrow a round runs several levels in one job. Every round ends in a reliable checkpoint, so lineage never
grows and a lost executor costs one round at most. What no frontier reached lies on or below a circle; circles are
told apart from the trees below them by pointer doubling over the unreached rest only.

Nodes with several parents are rare in forests, so the plan above is for the usual case; when the links turn out to
hold such a node, all links are kept and the general plan runs: frontiers take the smallest of the parents that reach
a node first, circles are the strongly connected components of all links (what is left after peeling sources and sinks,
split by label propagation), and ancestor pairs grow semi-naively over all links.

Hot parents: the link side of a level join may be skewed, the frontier side is unique per node, so AQE's skew join
can split it. Nothing is collected to the driver but one count per round.

Defined results
 * a null parent or child in a link is no link; repeated links and repeated nodes count once;
 * the path of a node with several parents is a shortest one, over the smallest parent at each step; its descendants
   and circles count all its links, distances are the shortest, and each of its links is in the link report;
 * a link from a parent that is no node leads nowhere: it makes an orphan of a node without other parents;
 * a node on a circle that a root reaches as well has a path and is circular; nodes that no root reaches are either
   ``cycle`` or ``below_cycle``;
 * repeated node rows with differing attributes keep the smallest attribute row (nulls last);
 * empty inputs give empty results; attribute columns may have any name, internal names start with ``__``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestlake.runtime import cut, fresh_dir, gathered

#: A frontier of at most this many rows makes the next round run several levels in one job.
NARROW_ROWS = 200_000
NARROW_LEVELS = 5
#: The first levels hold most nodes of a forest and are taken one by one.
WIDE_LEVELS = 5


@dataclass
class Forest:
    """reached: node, root, depth, path, broken, attributes, root_<attr>; circular: node, kind, cycle_id;
    links: all nodes with parent (null at roots), state root|orphan|linked, attributes; edges: all links as given;
    general: all links between nodes, where some node has several parents."""

    reached: DataFrame
    circular: DataFrame
    links: DataFrame
    edges: DataFrame
    general: DataFrame | None = None


def _distinct_nodes(nodes: DataFrame, attrs: list[str]) -> DataFrame:
    nodes = nodes.where(F.col("node").isNotNull())
    if not attrs:
        return nodes.groupBy("node").agg(F.lit(True).alias("__in"))
    packed = F.struct(*[x for a in attrs for x in (F.col(a).isNull().alias(f"__n_{a}"), F.col(a).alias(a))])
    one = nodes.groupBy("node").agg(F.min(packed).alias("__a"))
    return one.select("node", *[F.col(f"__a.{a}").alias(a) for a in attrs])


def build_forest(nodes: DataFrame, edges: DataFrame, attrs: list[str] | None = None, carry: list[str] | None = None) -> Forest:
    """nodes(node, attrs...), edges(parent, child). ``carry``: attributes of the root handed down as root_<attr>."""
    attrs, carry = attrs or [], carry or []
    nodes = _distinct_nodes(nodes, attrs)
    edges = edges.select("parent", "child").where(F.col("parent").isNotNull() & F.col("child").isNotNull())
    up = edges.groupBy("child").agg(F.min("parent").alias("parent"), (F.max("parent") != F.min("parent")).alias("multi_parent"))
    known = nodes.select(F.col("node").alias("__known"))
    links, seen = cut(
        nodes.join(up, nodes["node"] == up["child"], "left")
        .join(known, F.col("parent") == F.col("__known"), "left")
        .select(
            "node", "parent", "multi_parent",
            F.when(F.col("parent").isNull(), "root").when(F.col("__known").isNull(), "orphan").otherwise("linked").alias("state"),
            *attrs,
        ),
        F.count_if(F.col("state") == "linked").alias("linked"), F.count_if(F.col("state") != "linked").alias("heads"), F.count_if("multi_parent").alias("several"),
    )
    if seen["several"]:
        return _general(nodes, edges.distinct(), attrs, carry)
    folder = fresh_dir(nodes.sparkSession)
    frontier = cut(_heads(links, attrs, carry), into=folder)
    rest = links.where(F.col("state") == "linked").select("node", "parent", *attrs)
    rest_rows, rows = seen["linked"], seen["heads"]
    fresh, used, depth = [], 0, 1
    while rows and rest_rows:
        levels = 1 if rows > NARROW_ROWS or depth < WIDE_LEVELS else NARROW_LEVELS
        step, found = frontier, []
        for _ in range(levels):
            step = _descend(rest, step, attrs, carry)
            found.append(step)
        new = found[0]
        for x in found[1:]:
            new = new.unionByName(x)
        depth += levels
        new, seen = cut(new, F.count(F.lit(1)).alias("grown"), F.count_if(F.col("depth") == depth).alias("last"), into=folder)
        grown, rows = seen["grown"], seen["last"]
        fresh.append(new)
        frontier = new.where(F.col("depth") == depth)
        used += grown
        if rows and used * 2 > rest_rows:  # most of the links that each level scans are used up
            rest = cut(_minus(rest, fresh))
            rest_rows, used, fresh = rest_rows - used, 0, []
    left, seen = cut((_minus(rest, fresh) if fresh else rest).select("node", "parent"), F.count(F.lit(1)).alias("n"))
    return Forest(gathered(frontier, folder), _circles(left, seen["n"]), links, edges)


def _heads(links: DataFrame, attrs: list[str], carry: list[str]) -> DataFrame:
    return links.where(F.col("state") != "linked").select(
        "node", F.col("node").alias("root"), F.lit(1).alias("depth"), F.array("node").alias("path"),
        (F.col("state") == "orphan").alias("broken"), *attrs, *[F.col(c).alias(f"root_{c}") for c in carry])


def _descend(rest: DataFrame, frontier: DataFrame, attrs: list[str], carry: list[str]) -> DataFrame:
    f = frontier.select(F.col("node").alias("__p"), "root", "depth", "path", "broken", *[f"root_{c}" for c in carry])
    return rest.join(f, rest["parent"] == f["__p"]).select(
        "node", "root", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("node")).alias("path"), "broken",
        *attrs, *[f"root_{c}" for c in carry],
    )


def _minus(rest: DataFrame, parts: list[DataFrame]) -> DataFrame:
    seen = parts[0].select("node")
    for x in parts[1:]:
        seen = seen.unionAll(x.select("node"))
    return rest.join(seen, "node", "left_anti")


def _circles(left: DataFrame, n: int) -> DataFrame:
    """Split the unreached nodes: after enough doublings only nodes of circles are still ancestors of anything."""
    hop = left.select("node", F.col("parent").alias("anc"), F.least("node", "parent").alias("low"))
    span, image = 1, None  # low: smallest node among the first span ones on the way up
    while n:
        size = hop.select("anc").distinct().count()
        if image == size and span >= size:
            break
        image = size
        for _ in range(2):
            b = hop.select(F.col("node").alias("__b"), F.col("anc").alias("__anc"), F.col("low").alias("__low"))
            hop = hop.join(b, F.col("anc") == F.col("__b")).select("node", F.col("__anc").alias("anc"), F.least("low", "__low").alias("low"))
        hop = cut(hop)
        span *= 4
    on = hop.groupBy(F.col("anc").alias("__o")).agg(F.lit(True).alias("__on"))
    low = hop.select(F.col("node").alias("__c"), F.col("low").alias("cycle_id"))
    out = hop.join(on, F.col("node") == F.col("__o"), "left").join(low, F.col("anc") == F.col("__c"), "left").select(
        "node", F.when(F.col("__on"), "cycle").otherwise("below_cycle").alias("kind"), "cycle_id")
    return out


# ---- several parents

def _general(nodes: DataFrame, edges: DataFrame, attrs: list[str], carry: list[str]) -> Forest:
    """build_forest over links of any shape."""
    known = nodes.select(F.col("node").alias("__known"))
    own = cut(edges.join(nodes.select(F.col("node").alias("child")), "child").join(known, F.col("parent") == F.col("__known"), "left")
              .select("parent", "child", F.col("__known").isNotNull().alias("__live")))
    up = own.groupBy("child").agg(F.coalesce(F.min(F.when(F.col("__live"), F.col("parent"))), F.min("parent")).alias("parent"), F.bool_or("__live").alias("__some"))
    links = cut(nodes.join(up, nodes["node"] == up["child"], "left").select(
        "node", "parent", F.when(F.col("parent").isNull(), "root").when(F.col("__some"), "linked").otherwise("orphan").alias("state"), *attrs))
    inner = cut(own.where("__live").select("parent", "child"))
    folder = fresh_dir(nodes.sparkSession)
    rest = inner.join(nodes, F.col("child") == F.col("node")).select("parent", *nodes.columns)
    for state in ("root", "orphan"):  # a node that a root reaches is not lost, whatever else leads to it
        frontier, rows = cut(_heads(links.where(F.col("state") == state), attrs, carry), into=folder), 1
        while rows:
            step = _descend(rest, frontier, attrs, carry)
            step = step.groupBy("node").agg(F.min(F.struct("path", *[c for c in step.columns if c not in ("node", "path")])).alias("__s"))
            step = step.join(gathered(frontier, folder).select("node"), "node", "left_anti").select("node", *[F.col(f"__s.{c}").alias(c) for c in frontier.columns if c != "node"])
            frontier, seen = cut(step.select(*frontier.columns), F.count(F.lit(1)).alias("n"), into=folder)
            rows = seen["n"]
    reached = gathered(frontier, folder)
    on = _components(inner)
    lost = links.join(reached.select("node"), "node", "left_anti").join(on.select("node"), "node", "left_anti")
    circular = on.select("node", F.lit("cycle").alias("kind"), "cycle_id").unionByName(lost.select("node", F.lit("below_cycle").alias("kind"), F.lit(None).cast(on.schema["cycle_id"].dataType).alias("cycle_id")))
    return Forest(reached, circular, links, edges, inner)


def _peeled(live: DataFrame) -> tuple[DataFrame, int]:
    """The links that neither start at a source nor end at a sink, however often such are taken away."""
    n, before = None, None
    while n is None or n != before:
        before = n
        for _ in range(3):
            live = live.join(live.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
            live = live.join(live.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
        live, seen = cut(live.select("parent", "child"), F.count(F.lit(1)).alias("n"))
        n = seen["n"]
    return live, n


def _components(links: DataFrame) -> DataFrame:
    """(node, cycle_id) of the nodes on circles; cycle_id is the smallest node of the strongly connected component.

    Each turn labels every node with the smallest node that reaches it; the nodes that lead back to their label's node
    inside one label form its component and leave."""
    self_linked = links.where("parent = child").select(F.col("child").alias("node"), F.col("child").alias("cycle_id"))
    live, n = _peeled(links.where("parent <> child"))
    found = None
    while n:
        label = cut(live.select(F.col("child").alias("node"), F.least("parent", "child").alias("low")).groupBy("node").agg(F.min("low").alias("low")))
        changed = 1
        while changed:
            sent = live.join(label.select(F.col("node").alias("parent"), "low"), "parent").select(F.col("child").alias("node"), F.col("low").alias("__new")).groupBy("node").agg(F.min("__new").alias("__new"))
            label, seen = cut(label.join(sent, "node", "left").select("node", F.least("low", "__new").alias("low"), (F.col("__new") < F.col("low")).alias("__c")), F.count_if("__c").alias("n"))
            label, changed = label.select("node", "low"), seen["n"]
        within = cut(live.join(label.select(F.col("node").alias("parent"), F.col("low").alias("__a")), "parent").join(label.select(F.col("node").alias("child"), F.col("low").alias("__b")), "child")
                     .where("__a = __b").select("parent", "child", F.col("__a").alias("low")))
        folder = fresh_dir(links.sparkSession)
        back = cut(label.where("node = low"), into=folder)
        rows = 1
        while rows:
            step = within.join(back.select(F.col("node").alias("child")), "child").select(F.col("parent").alias("node"), "low").distinct()
            back, seen = cut(step.join(gathered(back, folder).select("node"), "node", "left_anti"), F.count(F.lit(1)).alias("n"), into=folder)
            rows = seen["n"]
        done = gathered(back, folder)
        own = done.join(done.groupBy("low").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("low"), "low").select("node", F.col("low").alias("cycle_id"))
        found = own if found is None else found.unionByName(own)
        gone = done.select("node")
        live, n = _peeled(live.join(gone.select(F.col("node").alias("parent")), "parent", "left_anti").join(gone.select(F.col("node").alias("child")), "child", "left_anti"))
    if found is None:
        return self_linked
    return found.unionByName(self_linked.join(found.select("node"), "node", "left_anti"))


def _all_pairs(forest: Forest) -> DataFrame:
    """Ancestor pairs over all links between reached nodes, each at its shortest distance; no node is its own ancestor."""
    there = forest.reached.select("node")
    links = cut(forest.general.join(there.select(F.col("node").alias("child")), "child", "left_semi").join(there.select(F.col("node").alias("parent")), "parent", "left_semi").where("parent <> child"))
    folder = fresh_dir(links.sparkSession)
    new, rows, far = cut(links.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("distance")), into=folder), 1, 1
    while rows:
        far += 1
        step = new.join(links, F.col("descendant") == F.col("parent")).where("ancestor <> child").select("ancestor", F.col("child").alias("descendant")).distinct()
        step = step.join(gathered(new, folder).select("ancestor", "descendant"), ["ancestor", "descendant"], "left_anti").withColumn("distance", F.lit(far))
        new, seen = cut(step, F.count(F.lit(1)).alias("n"), into=folder)
        rows = seen["n"]
    return gathered(new, folder)


def paths(forest: Forest) -> DataFrame:
    """(node, root, depth, path) of every node that reaches a real root."""
    return forest.reached.where(~F.col("broken")).select("node", "root", "depth", "path")


def descendants(forest: Forest) -> DataFrame:
    """(ancestor, descendant, distance >= 1): ancestor pairs are read off the paths, so no further shuffle, unless a
    node has several parents."""
    if forest.general is not None:
        return _all_pairs(forest)
    p = forest.reached.select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("__i", "ancestor"))
    return p.select("ancestor", "descendant", (F.col("depth") - 1 - F.col("__i")).alias("distance")).where("distance > 0")


def bad_links(forest: Forest) -> DataFrame:
    """(parent, child, problem): links that close a circle, lead nowhere or give a node one of several parents."""
    e = forest.edges.where(F.col("parent").isNotNull() & F.col("child").isNotNull()).distinct()
    on = forest.circular.where("kind = 'cycle'").select("node", "cycle_id")
    circ = e.join(on.select(F.col("node").alias("child"), F.col("cycle_id").alias("__c")), "child").join(on.select(F.col("node").alias("parent"), F.col("cycle_id").alias("__p")), "parent")
    circ = circ.where("__c = __p").select("parent", "child", F.lit("closes_circle").alias("problem"))
    known = forest.links.select("node")
    inside = e.join(known.select(F.col("node").alias("child")), "child", "left_semi")
    lost = inside.join(known.select(F.col("node").alias("parent")), "parent", "left_anti").select("parent", "child", F.lit("missing_parent").alias("problem"))
    gone = e.join(known.select(F.col("node").alias("child")), "child", "left_anti").select("parent", "child", F.lit("missing_child").alias("problem"))
    out = circ.unionByName(lost).unionByName(gone)
    if forest.general is None:
        return out
    several = inside.groupBy("child").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("child")
    return out.unionByName(inside.join(several, "child").select("parent", "child", F.lit("multi_parent").alias("problem")))
