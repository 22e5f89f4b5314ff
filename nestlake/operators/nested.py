"""Deeply nested JSON records -> related flat tables, by structural variants.

A tree automaton describes the records. Going down, a transition (state, member) -> state finds the nested objects
and numbers list elements; going up, each object's variant is decided from its members and from the states of its
children. The run is one ``explode`` per automaton level over VARIANT values: one scan, no shuffle, no Python.
Rows of a state share the supertype columns (record id, positions i/j/k, parent link, variant, common members);
``subtype_table`` gives the typed members of one variant.

Defined results
 * text that cannot be parsed, null text and repeated members (refused by the parser) give no rows;
 * null or missing is no row and, in a list, still takes its position; an empty object is a row;
 * a lone object in place of a list is element 0; text in place of an object or list is read as its JSON;
 * scalars (and lists in place of a single object) are no objects and give no row;
 * a record without id keeps a null id; further columns of the input are not carried along.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestlake.runtime import cut, fresh_dir, gathered


@dataclass(frozen=True)
class Edge:
    """Transition: from an object in state ``source`` through ``path`` to one child or a list of children."""

    source: str
    path: tuple[str, ...]
    target: str
    position: str | None = None  # i, j or k for lists


@dataclass(frozen=True)
class Rule:
    """An object is of ``variant`` if each member in ``has`` is of the kind named (object, array, text, any) or is
    itself of the variant set named; the first rule that holds decides."""

    variant: str
    has: dict[str, str] = field(default_factory=dict, hash=False)
    exact: bool = False  # no other members


@dataclass(frozen=True)
class Automaton:
    start: tuple[str, ...]
    edges: tuple[Edge, ...]
    rules: dict[str, tuple[Rule, ...]] = field(hash=False)
    common: dict[str, dict[str, str]] = field(hash=False)
    typed: dict[tuple[str, str], tuple[tuple[str, ...], dict[str, str]]] = field(hash=False)

    def levels(self) -> list[list[Edge]]:
        """Edges by distance from the start state; a recursive automaton has no end and is for ``flatten_deep``."""
        out, at = [], {"record"}
        while at:
            now = [e for e in self.edges if e.source in at]
            if not now:
                break
            if len(out) > len(self.edges):
                raise ValueError("the automaton is recursive")
            out.append(now)
            at = {e.target for e in now}
        return out


def _get(v: Column, member: str) -> Column:
    return F.try_variant_get(v, f"$.{member}", "variant")


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _let(v: Column, f: Callable[[Column], Column]) -> Column:
    """f(v) with v evaluated once, however often f names it."""
    return F.element_at(F.transform(F.array(v), f), 1)


def _parsed(v: Column) -> Column:
    """Text in place of a structure is that structure's JSON."""
    return F.try_parse_json(F.try_variant_get(v, "$", "string"))


def as_object(v: Column) -> Column:
    own = lambda x: F.when(_is_object(x), x)
    return _let(v, lambda x: F.when(_is_object(x), x).when(_list(x).isNull(), _let(_parsed(x), own)))


def as_list(v: Column) -> Column:
    """Elements, or the lone object as the only element; null if neither."""
    own = lambda x: F.coalesce(_list(x), F.when(_is_object(x), F.array(x)))
    return _let(v, lambda x: F.coalesce(own(x), _let(_parsed(x), own)))


def _follow(v: Column, path: tuple[str, ...]) -> Column:
    for member in path[:-1]:
        v = as_object(_get(v, member))
    return _get(v, path[-1])


_KINDS = {
    "object": lambda v: as_object(v).isNotNull(),
    "array": lambda v: _list(v).isNotNull(),
    "text": lambda v: F.try_variant_get(v, "$", "string").isNotNull() & ~_is_object(v) & _list(v).isNull(),
    "any": lambda v: v.isNotNull() & ~F.is_variant_null(v),
}


def classify(a: Automaton, state: str, v: Column) -> Column:
    """Variant of an object, bottom-up: kinds of its leaves first, then the rules of its state."""
    out = F.lit("other")
    members = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    for rule in reversed(a.rules.get(state, ())):
        ok = F.lit(True)
        for member, kind in rule.has.items():
            child = _get(v, member)
            ok = ok & (_KINDS[kind](child) if kind in _KINDS else (classify(a, kind.partition(":")[0], as_object(child)) == kind.partition(":")[2]))
        if rule.exact:
            ok = ok & (F.size(members) == len(rule.has))
        out = F.when(ok, rule.variant).otherwise(out)
    return out


def _row(flat: str, parent: Column, i: Column, j: Column, k: Column, node: Column, pi: Column, pj: Column, pk: Column) -> Column:
    return F.struct(F.lit(flat).alias("flat"), i.alias("i"), j.alias("j"), k.alias("k"), parent.alias("parent_flat"),
                    pi.alias("parent_i"), pj.alias("parent_j"), pk.alias("parent_k"), node.alias("node"))


def _numbered(e: Edge, pos: dict[str, Column], up: tuple) -> Callable[[Column, Column], Column]:
    def make(x: Column, n: Column) -> Column:
        at = pos | {e.position: n}
        return _row(e.target, up[0], at["i"], at["j"], at["k"], as_object(x), *up[1:])

    return make


def flatten(df: DataFrame, a: Automaton, rec_id: str, json: str) -> DataFrame:
    """(rec_id, flat, i, j, k, parent_flat, parent_i, parent_j, parent_k, variant, node): one row per nested object."""
    none = F.lit(-1)
    v = F.try_parse_json(F.col(json))
    for member in a.start:
        v = as_object(_get(v, member))
    cur = df.select(F.col(rec_id).alias(rec_id), v.alias("__start")).where("__start IS NOT NULL").select(
        rec_id, _row("record", F.lit(None).cast("string"), none, none, none, F.col("__start"), none, none, none).alias("__r"), F.lit(0).alias("__level"))
    for level, edges in enumerate(a.levels()):
        r = F.col("__r")
        empty = F.array().cast(T.ArrayType(cur.schema["__r"].dataType))
        grown = empty
        for e in edges:
            child = _follow(r["node"], e.path)
            pos = {x: r[x] for x in "ijk"}
            up = (r["flat"], r["i"], r["j"], r["k"])
            if e.position:
                kids = F.transform(as_list(child), _numbered(e, pos, up))
            else:
                kids = F.array(_row(e.target, up[0], pos["i"], pos["j"], pos["k"], as_object(child), *up[1:]))
            here = F.when((r["flat"] == e.source) & (F.col("__level") == level), kids)
            grown = F.concat(grown, F.coalesce(here, empty))
        kids = F.transform(F.filter(grown, lambda x: x["node"].isNotNull()), lambda x: F.struct(x.alias("r"), F.lit(level + 1).alias("level")))
        own = F.array(F.struct(r.alias("r"), F.col("__level").alias("level")))
        cur = cur.select(rec_id, F.explode(F.concat(own, kids)).alias("__x")).select(rec_id, F.col("__x.r").alias("__r"), F.col("__x.level").alias("__level"))
    rows = cur.where("__r.flat <> 'record'").select(rec_id, "__r.*")
    variant = F.lit("other")
    for state in a.rules:
        variant = F.when(F.col("flat") == state, classify(a, state, F.col("node"))).otherwise(variant)
    return rows.withColumn("variant", variant)


def _placed(target: str) -> Callable[[Column, Column], Column]:
    def make(x: Column, n: Column) -> Column:
        return F.struct(F.lit(target).alias("flat"), F.concat("place", F.array(n)).alias("place"), as_object(x).alias("node"))

    return make


def flatten_deep(df: DataFrame, a: Automaton, rec_id: str, json: str) -> DataFrame:
    """(rec_id, flat, place, parent_flat, parent_place, variant, node) for automata of any shape: records may nest in
    themselves, and any number of lists may lie in one another. ``place`` holds a position for each step from the record
    (-1 where the step is no list), so a row's parent is the row of its place without the last one. Levels are taken
    one by one, each a scan of the rows of the one before only, until no object is found."""
    v = F.try_parse_json(F.col(json))
    for member in a.start:
        v = as_object(_get(v, member))
    spot = F.array().cast("array<int>")
    cur = cut(df.select(F.col(rec_id).alias(rec_id), v.alias("node")).where("node IS NOT NULL").select(rec_id, F.lit("record").alias("flat"), spot.alias("place"), F.lit(None).cast("string").alias("parent_flat"), spot.alias("parent_place"), "node"))
    folder, n = fresh_dir(df.sparkSession), 1
    first = cut(cur.where("false"), into=folder)
    while n:
        grown = none = F.array().cast("array<struct<flat:string,place:array<int>,node:variant>>")
        for e in a.edges:
            child = _follow(F.col("node"), e.path)
            row = _placed(e.target)
            kids = F.transform(as_list(child), row) if e.position else F.array(row(child, F.lit(-1)))
            grown = F.concat(grown, F.coalesce(F.when(F.col("flat") == e.source, kids), none))
        step = cur.select(rec_id, F.col("flat").alias("parent_flat"), F.col("place").alias("parent_place"), F.explode(F.filter(grown, lambda x: x["node"].isNotNull())).alias("__k"))
        cur, seen = cut(step.select(rec_id, "__k.flat", "__k.place", "parent_flat", "parent_place", "__k.node"), F.count(F.lit(1)).alias("n"), into=folder)
        n = seen["n"]
    variant = F.lit("other")
    for state in a.rules:
        variant = F.when(F.col("flat") == state, classify(a, state, F.col("node"))).otherwise(variant)
    return gathered(first, folder).withColumn("variant", variant)


def supertype_table(rows: DataFrame, a: Automaton, rec_id: str, flat: str) -> DataFrame:
    """All variants of one state: keys, parent link, variant, the members that variants have in common, and the whole
    object, which also holds the members that are not typed."""
    inner = F.col("node")
    if any(f == flat and p for (f, _), (p, _) in a.typed.items()):  # members sit inside the one wrapping member
        inner = F.coalesce(*[as_object(_get(F.col("node"), p[0])) for (f, _), (p, _) in a.typed.items() if f == flat and p], F.col("node"))
    return rows.where(F.col("flat") == flat).select(
        rec_id, "i", "j", "k", "parent_flat", "parent_i", "parent_j", "parent_k", "variant",
        *[F.try_variant_get(inner, f"$.{m}", t).alias(m) for m, t in a.common.get(flat, {}).items()], F.col("node").alias("members"))


def subtype_table(rows: DataFrame, a: Automaton, rec_id: str, flat: str, variant: str) -> DataFrame:
    """Typed members of one variant, with the keys that lead to its supertype row."""
    path, members = a.typed[(flat, variant)]
    node = F.col("node")
    for member in path:
        node = as_object(_get(node, member))
    return rows.where((F.col("flat") == flat) & (F.col("variant") == variant)).select(
        rec_id, "i", "j", "k", *[F.try_variant_get(node, f"$.{m}", t).alias(m) for m, t in members.items()])
