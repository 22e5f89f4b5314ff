"""Syntax tree of the object query language."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    value: object  # bool, float/int or str


@dataclass(frozen=True)
class Ident:
    name: str


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class Compare:
    op: str  # == != < <= > >=
    left: object
    right: object


@dataclass(frozen=True)
class Among:
    """left [not] in (values) or in a selector."""

    left: object
    values: tuple | Variable
    negated: bool = False


@dataclass(frozen=True)
class Chain:
    """Alternating parts and ``and``/``or``; AND binds tighter."""

    parts: tuple
    glue: tuple[str, ...]


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class TextTest:
    """kind: equals, regex, iregex, starts_with, any (several tests), selector."""

    kind: str
    value: object
    negated: bool = False


@dataclass(frozen=True)
class Call:
    """A function with its arguments, e.g. has_symbol, date_range, has_child."""

    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Path:
    steps: tuple  # str: member, int: index


@dataclass(frozen=True)
class MetaTest:
    """Something said of the items of a path; root: object or relation."""

    root: str
    path: Path
    kind: str  # exists, compare, text, length, object, in, selector
    value: object = None


@dataclass(frozen=True)
class Member:
    """Inside an element match: a member of that element."""

    name: str


@dataclass(frozen=True)
class MemberTest:
    member: Member
    kind: str  # compare, text, in
    value: object


@dataclass(frozen=True)
class Selector:
    """Values taken from the local work: column or function, its path, and a filter on the nodes."""

    get: str
    path: Path | None = None
    where: object = None


@dataclass(frozen=True)
class Pattern:
    text: str  # canonical hexadecimal form
    offset: str = "*"


@dataclass(frozen=True)
class Settings:
    """Of a query over neighbouring works."""

    relation: str  # none, more, less
    number: int = 0
    percent: bool = False
    window_us: int = 0
    max_neighbors: int | None = None


@dataclass(frozen=True)
class Query:
    body: object
    variables: dict = field(default_factory=dict, hash=False)
    settings: Settings | None = None
