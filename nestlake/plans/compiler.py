"""Query tree -> DataFrame plan.

An inner condition never mentions the outer node, so nested conditions are evaluated bottom-up and uncorrelated: the
nodes that match the inner condition are reduced to one count per key (parent, ancestor, descendant, work ...), partial
sums before the shuffle, and left-joined to the outer nodes, a missing count being 0. That works the same below OR, NOT
and in arithmetic, and leaves join strategy and skew to AQE. Everything else is a Column over VARIANT, map and array
columns, so scans stay pruned and filters are pushed down.

Nodes: id, work_id, object_id, org, object_type, object_subtype, is_entry, recursion_level, size, entropy, t,
hashes map<string,string>, result string (JSON), parent long, props string (JSON). ``keys`` are the columns within which
trees are told apart: work_id, or (local, work_id) where works are looked at on behalf of others.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestlake.functions import laxjson as J
from nestlake.plans import ast as A
from nestlake.plans.patterns import identity

OPS: dict[str, Callable] = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
COLUMNS = ("id", "work_id", "object_id", "org", "object_type", "object_subtype", "is_entry", "recursion_level", "size", "entropy", "t", "hashes", "result", "parent", "props")
MAX_DEPTH = 1000


LINKS = ("parent", "props")


class Nodes:
    """Node rows of stored tables, planned for each use: row conditions go to the scan, repeated rows count once only
    among those that are left, and links are joined only where a condition looks at them.

    Rows repeated with differing content (which no store should hold) keep the smallest value of each column; of several
    links of a node the one with the largest parent counts. Without ``rels`` the rows are taken as they are.
    """

    def __init__(self, objects: DataFrame, rels: DataFrame | None = None, narrow: Callable[[DataFrame], DataFrame] | None = None, keys: tuple[str, ...] = ()) -> None:
        self.objects, self.rels, self.narrow, self.keys = objects, rels, narrow, keys

    def within(self, narrow: Callable[[DataFrame], DataFrame], *keys: str) -> Nodes:
        """The same nodes, joined with what ``narrow`` joins them with; ``keys``: columns that this adds."""
        return Nodes(self.objects, self.rels, narrow, keys)

    def rows(self, pre: Column | None = None, links: bool = True) -> DataFrame:
        x, own = self.objects, [c for c in COLUMNS if c not in LINKS]
        if self.rels is None:
            x = x if pre is None else x.where(pre)
            x = x if self.narrow is None else self.narrow(x)
            return x.select(*self.keys, *own, *(LINKS if links else ()))
        if "entropy" not in x.columns:
            x = x.withColumn("entropy", F.lit(None).cast("double"))
        text = x.schema["hashes"].dataType.simpleString() == "string"
        parsed = lambda: F.from_json("hashes", "map<string,string>") if text else F.col("hashes")
        if pre is not None:
            x = x.withColumn("__h", F.col("hashes")).withColumn("hashes", parsed()).where(pre).withColumn("hashes", F.col("__h"))
        x = x.groupBy("id").agg(*[(F.min(c) if text or c != "hashes" else F.any_value(c)).alias(c) for c in own if c != "id"])
        x = x.withColumn("hashes", parsed()).select(*own)
        x = x if self.narrow is None else self.narrow(x)
        if not links:
            return x
        up = self.own_links().withColumnRenamed("child", "__child")
        return x.join(up, F.col("id") == F.col("__child"), "left").drop("__child").select(*self.keys, *COLUMNS)

    def own_links(self) -> DataFrame:
        """(child, parent, props): one link of each node."""
        if self.rels is None:
            return self.objects.select(F.col("id").alias("child"), *LINKS)
        return self.rels.groupBy("child").agg(F.max(F.struct(*LINKS)).alias("r")).select("child", "r.*")


def nodes(objects: DataFrame, rels: DataFrame) -> DataFrame:
    """Stored tables -> all node rows."""
    return Nodes(objects, rels).rows()


def symbols(result: str = "result") -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json(result), "$.ok.symbols", "array<string>"), F.array().cast("array<string>"))


def names(props: str = "props") -> Column:
    p = F.try_parse_json(props)
    one = F.try_variant_get(p, "$.name", "string")
    many = F.coalesce(F.try_variant_get(p, "$.names", "array<string>"), F.array().cast("array<string>"))
    return F.array_compact(F.array_distinct(F.concat(F.array(one), many)))


_ROW_CALLS = ("get_hash", "has_symbol", "has_name", "has_error", "is_root", "date_since", "date_range", "match_pattern", "count_conditions")


def _parts(c: object) -> tuple:
    if isinstance(c, A.Chain):
        return c.parts
    if isinstance(c, A.Not):
        return (c.part,)
    if isinstance(c, A.Compare):
        return (c.left, c.right)
    if isinstance(c, A.Among):
        return (c.left,)
    return c.args if isinstance(c, A.Call) and c.name == "count_conditions" else ()


def by_row(c: object) -> bool:
    """Whether a condition is settled by the node's own row, so that no join is planned for it."""
    if isinstance(c, A.Call) and (c.name not in _ROW_CALLS or (c.args and isinstance(c.args[0], A.TextTest) and c.args[0].kind == "selector")):
        return False
    if (isinstance(c, A.MetaTest) and c.kind == "selector") or (isinstance(c, A.Among) and isinstance(c.values, A.Variable)):
        return False
    return all(by_row(p) for p in _parts(c))


def by_link(c: object) -> bool:
    """Whether a condition looks at the node's link: its parent or the properties of the relation."""
    if isinstance(c, A.Call) and c.name in ("has_name", "has_parent", "has_sibling", "count_siblings"):
        return True
    return (isinstance(c, A.MetaTest) and c.root == "relation") or any(by_link(p) for p in _parts(c))


def conjuncts(c: object) -> list:
    if isinstance(c, A.Chain) and all(g == "and" for g in c.glue):
        return [y for x in c.parts for y in conjuncts(x)]
    return [c]


def mentioned(x: object) -> set[str]:
    """Names of the variables in a condition."""
    if isinstance(x, A.Variable):
        return {x.name}
    if isinstance(x, (tuple, list)):
        return {n for y in x for n in mentioned(y)}
    return {n for f in getattr(x, "__dataclass_fields__", ()) for n in mentioned(getattr(x, f))}


def shared(c: object, selectors: set[str]) -> tuple[object, str, list] | None:
    """(test, selector, other conjuncts) if all that a condition asks of selectors is that a node holds a value of one."""
    tests = [x for x in conjuncts(c) if mentioned(x) & selectors]
    if len(tests) != 1:
        return None
    test, variable, inner = tests[0], None, ()
    if isinstance(test, A.Among) and not test.negated:
        variable, inner = test.values, test.left
    elif isinstance(test, A.Call) and test.name in ("has_symbol", "has_name") and test.args[0].kind == "selector" and not test.args[0].negated:
        variable = test.args[0].value
    elif isinstance(test, A.MetaTest) and test.kind == "selector" and not test.value[1]:
        variable = test.value[0]
    if not isinstance(variable, A.Variable) or mentioned(inner) & selectors:
        return None
    return test, variable.name, [x for x in conjuncts(c) if x is not test]


class Compiler:
    """Compiles conditions over one set of nodes. ``closure``: () -> DataFrame(anc, desc, depth), made when first needed."""

    def __init__(self, base: Nodes, closure: Callable[[], DataFrame] | None = None, variables: dict | None = None, keys: tuple[str, ...] = ("work_id",),
                 selectors: dict[str, DataFrame] | None = None, pattern_tag: str = "Pattern.", compat: bool = False) -> None:
        self.base, self.closure, self.variables, self.keys = base, closure, variables or {}, keys
        self.selectors, self.tag, self.compat = selectors or {}, pattern_tag, compat
        self.names = (f"__f{k}" for k in itertools.count())
        self.memo: dict = {}

    def select(self, cond: object, links: bool = False) -> DataFrame:
        """The nodes for which the condition is true, with parent and props if ``links``. Conjuncts that concern the row
        alone are applied before anything is shuffled."""
        pre, rest = None, []
        for c in conjuncts(cond):
            if by_row(c) and not by_link(c):
                x = self.flag(None, c)[1]
                pre = x if pre is None else pre & x
            else:
                rest.append(c)
        df = self.base.rows(pre, links or any(by_link(c) for c in rest))
        columns = [c for c in df.columns if links or c not in LINKS]
        for c in rest:
            df, x = self.flag(df, c)
            df = df.where(x)
        return df.select(*columns)

    # -- conditions

    def flag(self, df: DataFrame, c: object) -> tuple[DataFrame, Column]:
        if isinstance(c, A.Chain):
            cols = []
            for p in c.parts:
                df, x = self.flag(df, p)
                cols.append(x)
            groups = [cols[0]]
            for g, x in zip(c.glue, cols[1:], strict=True):
                if g == "and":
                    groups[-1] = groups[-1] & x
                else:
                    groups.append(x)
            out = groups[0]
            for g in groups[1:]:
                out = out | g
            return df, out
        if isinstance(c, A.Not):
            df, x = self.flag(df, c.part)
            return df, ~x
        if isinstance(c, A.Literal):
            return df, F.lit(c.value)
        if isinstance(c, A.Compare):
            df, left = self.value(df, c.left)
            df, right = self.value(df, c.right)
            return df, OPS[c.op](left, right)
        if isinstance(c, A.Among):
            df, left = self.value(df, c.left)
            if isinstance(c.values, A.Variable):
                return self._in_selector(df, left, c.values, c.negated)
            inside = left.isin([self.constant(v) for v in c.values])
            return df, ~inside if c.negated else inside
        if isinstance(c, A.MetaTest):
            return self._meta(df, c)
        return self.value(df, c)

    def value(self, df: DataFrame, x: object) -> tuple[DataFrame, Column]:
        if isinstance(x, A.Ident):
            return df, F.col(x.name)
        if isinstance(x, (A.Literal, A.Variable)):
            return df, F.lit(self.constant(x))
        if isinstance(x, A.Call):
            return self._call(df, x)
        return self.flag(df, x)

    def constant(self, x: object) -> object:
        if isinstance(x, A.Variable):
            x = self.variables[x.name]
        return x.value if isinstance(x, A.Literal) else x

    def _call(self, df: DataFrame, c: A.Call) -> tuple[DataFrame, Column]:
        name = c.name
        if name == "get_hash":
            return df, F.col("hashes")[F.lit(c.args[0])]
        if name in ("has_symbol", "has_name"):
            return self._any_text(df, symbols() if name == "has_symbol" else names(), c.args[0])
        if name == "has_error":
            error = F.try_variant_get(F.try_parse_json("result"), "$.error", "string")
            return df, self.text(c.args[0], error) if c.args else error.isNotNull()
        if name == "is_root":
            return df, F.col("is_entry")
        if name == "is_leaf":
            df, n = self._counted(df, ("leaf",), lambda: self._grouped(self.base.rows(), "parent"), "id")
            return df, n == 0
        if name == "date_since":
            return df, F.col("t") >= F.lit(self.constant(c.args[0])[0])
        if name == "date_range":
            (lo, _), (hi, timed) = (self.constant(a) for a in c.args)
            if timed and self.compat:  # the time of day of the upper bound is dropped there
                hi = hi.replace(hour=0, minute=0, second=0)
            end = F.lit(hi) + (F.expr("INTERVAL 1 SECOND") if timed else F.expr("INTERVAL 1 DAY"))
            return df, (F.col("t") >= F.lit(lo)) & (F.col("t") < end)
        if name == "match_pattern":
            p = self.constant(c.args[0])
            return df, F.array_contains(symbols(), self.tag + identity(p.text, p.offset))
        if name == "count_conditions":
            total = F.lit(0)
            for node in c.args:
                df, x = self.flag(df, node)
                total = total + F.when(F.coalesce(x, F.lit(False)), 1).otherwise(0)
            return df, total
        df, n = self._tree(df, c)
        return df, n > 0 if name.startswith("has_") else n

    # -- trees

    def _tree(self, df: DataFrame, c: A.Call) -> tuple[DataFrame, Column]:
        kind = c.name.partition("_")[2]
        inner, depth = c.args
        depth = MAX_DEPTH if depth is None else depth
        hit = lambda links=False: self.base.rows(None, links) if inner is None else self.select(inner, links)
        if kind in ("child", "children"):
            return self._counted(df, ("child", inner), lambda: self._grouped(hit(True), "parent"), "id")
        if kind == "parent":
            return self._counted(df, ("parent", inner), lambda: self._grouped(hit(), "id"), "parent")
        if kind == "root":
            return self._counted(df, ("root", inner), lambda: self._grouped(hit().where("is_entry"), None), None)
        if kind in ("sibling", "siblings"):
            df, all_of = self._counted(df, ("child", inner), lambda: self._grouped(hit(True), "parent"), "parent")
            df, self_too = self._counted(df, ("self", inner), lambda: self._grouped(hit(), "id"), "id")
            return df, F.when(F.col("parent").isNull(), 0).otherwise(all_of - self_too)
        near, far = ("anc", "desc") if kind in ("descendant", "descendants") else ("desc", "anc")

        def counts() -> DataFrame:
            m = hit().select(*self.keys, F.col("id").alias("__far"))
            pairs = self.closure().where(F.col("depth") <= depth).select(F.col(near).alias("__at"), F.col(far).alias("__m"))
            return m.join(pairs, F.col("__far") == F.col("__m")).groupBy(*self.keys, "__at").agg(F.count(F.lit(1)).alias("__n"))

        return self._counted(df, (kind.rstrip("s"), inner, depth), counts, "id")

    def _grouped(self, m: DataFrame, by: str | None) -> DataFrame:
        """One count per work, or per work and node."""
        if by is None:
            return m.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("__n"))
        return m.where(F.col(by).isNotNull()).groupBy(*self.keys, F.col(by).alias("__at")).agg(F.count(F.lit(1)).alias("__n"))

    def _counted(self, df: DataFrame, key: tuple, make: Callable[[], DataFrame], on: str | None) -> tuple[DataFrame, Column]:
        """df with the count joined; the same inner condition is planned once."""
        if key not in self.memo:
            self.memo[key] = make()
        n = next(self.names)
        mine = {k: f"{n}_{k}" for k in self.keys}
        counts = self.memo[key].select(*[F.col(k).alias(v) for k, v in mine.items()], F.col("__n").alias(n), *([F.col("__at").alias(f"{n}_at")] if on else []))
        same = [F.col(k) == F.col(v) for k, v in mine.items()] + ([F.col(on) == F.col(f"{n}_at")] if on else [])
        cond = same[0]
        for s in same[1:]:
            cond = cond & s
        return df.join(counts, cond, "left"), F.coalesce(F.col(n), F.lit(0))

    # -- text

    def text(self, t: A.TextTest, v: Column) -> Column:
        if t.kind == "any":
            out = F.lit(False)
            for x in t.value:
                out = out | self.text(x, v)
            return out
        s = self.constant(t.value)
        if t.kind == "equals":
            return v == F.lit(s)
        if t.kind == "starts_with":
            return v.startswith(s)
        return v.rlike(("(?i)" if t.kind == "iregex" else "") + s)

    def _any_text(self, df: DataFrame, values: Column, t: A.TextTest) -> tuple[DataFrame, Column]:
        if t.kind == "selector":
            return self._lists_meet(df, values, t.value, t.negated, True)
        if t.kind == "equals":
            return df, F.array_contains(values, self.constant(t.value))
        return df, F.exists(values, lambda x: self.text(t, x))

    # -- metadata

    def _root(self, root: str) -> Column:
        if root == "object":
            return F.try_variant_get(F.try_parse_json("result"), "$.ok.object_metadata", "variant")
        return F.try_parse_json("props")

    def _meta(self, df: DataFrame, m: A.MetaTest) -> tuple[DataFrame, Column]:
        root = self._root("object" if m.kind == "length" and self.compat else m.root)
        found = F.coalesce(J.items(root, m.path.steps), F.array().cast("array<variant>"))
        if m.kind == "exists":
            return df, J.any_of(J.unwrapped(found), lambda e: ~J.is_null(e))
        if m.kind == "selector":
            variable, negated = m.value
            return self._lists_meet(df, self._canonical(m), variable, negated, m.root == "relation")
        each = J.unwrapped(found)
        if m.kind == "text":
            return df, J.any_of(each, lambda e: self.text(m.value, J.text(e)))
        if m.kind == "length":
            op, n = m.value
            return df, J.any_of(each, lambda e: OPS[op](F.length(J.text(e)), F.lit(self.constant(n))))
        if m.kind == "in":
            tests = [self._item_test(x, root, J.items) for x in m.value]
            return df, J.any_of(each, lambda e: _any(f(e) for f in tests))
        if m.kind == "object":
            return df, J.any_of(each, lambda e: F.coalesce(self._element(m.value, e), F.lit(False)))
        op, value = m.value
        test = self._item_test(value, root, J.items, "==" if op == "!=" else op)
        out = J.any_of(each, test)
        return df, ~out if op == "!=" else out

    def _canonical(self, m: A.MetaTest) -> Column:
        return F.transform(F.coalesce(J.items(self._root(m.root), m.path.steps), F.array().cast("array<variant>")), J.canonical)

    def _item_test(self, x: object, root: Column, other: Callable, op: str = "==") -> Callable[[Column], Column]:
        """Test of one item against a constant, a text test, or the items of another path."""
        if isinstance(x, A.TextTest):
            return lambda e: self.text(x, J.text(e))
        if isinstance(x, (A.Path, A.Member)):
            steps = x.steps if isinstance(x, A.Path) else (x.name,)
            values = J.unwrapped(F.coalesce(other(root, steps), F.array().cast("array<variant>")))
            return lambda e: J.any_of(values, lambda y: _same_type(op, e, y))
        value = self.constant(x)
        return lambda e: OPS[op](J.typed(e, value), F.lit(value))

    def _element(self, c: object, e: Column) -> Column:
        """Condition on the members of one element."""
        if isinstance(c, A.Chain):
            groups = [self._element(c.parts[0], e)]
            for g, p in zip(c.glue, c.parts[1:], strict=True):
                x = self._element(p, e)
                if g == "and":
                    groups[-1] = groups[-1] & x
                else:
                    groups.append(x)
            return _any(groups)
        own = J.unwrapped(J.items(e, (c.member.name,)))
        if c.kind == "text":
            return J.any_of(own, lambda v: self.text(c.value, J.text(v)))
        if c.kind == "in":
            tests = [self._item_test(x, e, J.items) for x in c.value]
            return J.any_of(own, lambda v: _any(f(v) for f in tests))
        op, value = c.value
        if op != "!=" or isinstance(value, A.Member):
            return J.any_of(own, self._item_test(value, e, J.items, op))
        constant = self.constant(value)  # another type differs as well; an absent member does not
        return J.any_of(own, lambda v: F.coalesce(J.typed(v, constant) != F.lit(constant), F.lit(True)))

    # -- selectors

    def _selected(self, v: A.Variable) -> DataFrame:
        """(keys that the selector depends on, value): what the local works hold."""
        return self.selectors[v.name]

    def _in_selector(self, df: DataFrame, left: Column, v: A.Variable, negated: bool) -> tuple[DataFrame, Column]:
        n = next(self.names)
        sel = self._selected(v)
        by = [k for k in self.keys if k in sel.columns]
        has = sel.where("value IS NOT NULL").select(*[F.col(k).alias(f"{n}_{k}") for k in by], F.col("value").alias(f"{n}_v")).distinct().withColumn(n, F.lit(True))
        cond = left.cast("string") == F.col(f"{n}_v")
        for k in by:
            cond = cond & (F.col(k) == F.col(f"{n}_{k}"))
        df = df.join(has, cond, "left")
        inside = F.col(n).isNotNull()
        if not negated:
            return df, inside
        gaps = sel.groupBy(*by).agg(F.bool_or(F.col("value").isNull()).alias(f"{n}_g"), F.count(F.lit(1)).alias(f"{n}_c")).select(*[F.col(k).alias(f"{n}g_{k}") for k in by], f"{n}_g", f"{n}_c")
        if by:
            cond = F.lit(True)
            for k in by:
                cond = cond & (F.col(k) == F.col(f"{n}g_{k}"))
            df = df.join(gaps, cond, "left")
        else:  # a sum over everything: exactly one row
            df = df.crossJoin(F.broadcast(gaps))
        unknown = (left.isNull() & (F.coalesce(F.col(f"{n}_c"), F.lit(0)) > 0)) | F.coalesce(F.col(f"{n}_g"), F.lit(False))
        return df, F.when(inside, False).when(unknown, None).otherwise(True)

    def _lists_meet(self, df: DataFrame, values: Column, v: A.Variable, negated: bool, links: bool) -> tuple[DataFrame, Column]:
        """Whether any of the values is among the selector's: one row per (node, value), matched by an equi-join."""
        n = next(self.names)
        sel = self._selected(v)
        by = [k for k in self.keys if k in sel.columns]
        each = self.base.rows(None, links).select(*self.keys, F.col("id").alias("__id"), F.explode(values).alias("__v"))
        has = sel.where("value IS NOT NULL").select(*[F.col(k).alias(f"__s_{k}") for k in by], F.col("value").alias("__sv")).distinct()
        cond = F.col("__v") == F.col("__sv")
        for k in by:
            cond = cond & (F.col(k) == F.col(f"__s_{k}"))
        hit = each.join(has, cond, "left_semi").groupBy(*[F.col(k).alias(f"{n}_{k}") for k in self.keys], F.col("__id").alias(f"{n}_id")).agg(F.lit(True).alias(n))
        on = F.col("id") == F.col(f"{n}_id")
        for k in self.keys:
            on = on & (F.col(k) == F.col(f"{n}_{k}"))
        df = df.join(hit, on, "left")
        return df, F.col(n).isNull() if negated else F.col(n).isNotNull()

    def held(self, test: object, rest: list) -> DataFrame:
        """(keys, value): what the nodes for which all of ``rest`` holds have to show to a selector test."""
        links = by_link(test)
        df = self.select(A.Chain(tuple(rest), ("and",) * (len(rest) - 1)), links) if rest else self.base.rows(None, links)
        if isinstance(test, A.Among):
            df, left = self.value(df, test.left)
            value = left.cast("string")
        elif isinstance(test, A.Call):
            value = F.explode(symbols() if test.name == "has_symbol" else names())
        else:
            value = F.explode(self._canonical(test))
        return df.select(*self.keys, value.alias("value")).where("value IS NOT NULL")

    def selector_values(self, s: A.Selector, local: str = "work_id") -> DataFrame:
        """(local, value) of a selector over these nodes; values as text, JSON values in canonical form."""
        links = s.get in ("get_names", "get_relation_meta")
        df = self.base.rows(None, links) if s.where is None else self.select(s.where, links)
        if s.get == "get_symbols":
            value = F.explode(symbols())
        elif s.get == "get_names":
            value = F.explode(names())
        elif s.path is not None:
            root = self._root("object" if s.get == "get_object_meta" else "relation")
            value = F.explode(F.transform(J.items(root, s.path.steps), J.canonical))
        else:
            value = F.col(s.get).cast("string")
        return df.select(F.col("work_id").alias(local), value.alias("value"))


def _any(cols) -> Column:
    out = None
    for c in cols:
        out = c if out is None else out | c
    return out


def _same_type(op: str, a: Column, b: Column) -> Column:
    """Comparison of two JSON values; values of different types compare as unknown, except that null differs from all."""
    f = OPS[op]
    out = F.coalesce(f(J.number(a), J.number(b)), f(J.text(a), J.text(b)), f(J.boolean(a), J.boolean(b)))
    if op == "==":
        return F.when(J.is_null(a) & J.is_null(b), True).otherwise(out)
    return F.when(J.is_null(a) != J.is_null(b), True).otherwise(out) if op == "!=" else out
