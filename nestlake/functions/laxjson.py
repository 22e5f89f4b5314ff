"""Lax JSON paths over VARIANT: arrays unwrap one level on member access and in tests, scalars act as arrays of one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMERIC = ("TINYINT", "SMALLINT", "INT", "BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def unwrap(v: Column) -> Column:
    """array<variant>: the elements of an array, or the value itself."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))


def member(v: Column, name: str) -> Column:
    """Member of an object; SQL NULL if v is no object or lacks it. Any name will do, so no path text is built."""
    return F.try_variant_get(v, "$", "map<string,variant>")[F.lit(name)]


def items(root: Column, steps: tuple) -> Column:
    """array<variant>: all values that the path leads to, absent ones left out."""
    out = F.array(root)
    for s in steps:
        out = _members(out, s) if isinstance(s, str) else _indexed(out, s)
    return F.filter(out, lambda x: x.isNotNull())


def _members(values: Column, name: str) -> Column:
    found = F.flatten(F.transform(values, lambda x: F.transform(unwrap(x), lambda e: member(e, name))))
    return F.filter(found, lambda y: y.isNotNull())


def _indexed(values: Column, n: int) -> Column:
    return F.filter(F.transform(values, lambda x: F.get(unwrap(x), F.lit(n))), lambda y: y.isNotNull())


def unwrapped(values: Column) -> Column:
    return F.flatten(F.transform(values, unwrap))


def any_of(values: Column, test: Callable[[Column], Column]) -> Column:
    """Two-valued: true if the test holds for some item."""
    return F.coalesce(F.exists(values, lambda e: F.coalesce(test(e), F.lit(False))), F.lit(False))


def is_null(v: Column) -> Column:
    return F.is_variant_null(v)


def text(v: Column) -> Column:
    """String value, NULL for any other type."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def number(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    ok = F.lit(False)
    for k in _NUMERIC:
        ok = ok | kind.startswith(k)
    return F.when(ok, F.try_variant_get(v, "$", "double"))


def boolean(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))


def typed(v: Column, value: object) -> Column:
    """v as the type of a Python value, NULL if it is of another."""
    return boolean(v) if isinstance(value, bool) else number(v) if isinstance(value, (int, float)) else text(v)


def canonical(v: Column) -> Column:
    """Text that is equal for equal values: members sorted, 1.0 written as 1."""
    return F.to_json(v)
