"""Contract of a processor, limits, and a small binary reader."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from dataclasses import dataclass, field


class Malformed(Exception):
    """The content is not what its type says: a permanent error, reported in the result."""


@dataclass(frozen=True)
class Limits:
    input_bytes: int = 262_144_000
    child_bytes: int = 41_943_040
    total_bytes: int = 262_144_000
    children: int = 100


# Limits of single processors that differ from the general ones.
LIMITS = {"Text": Limits(10_485_760, 10_485_760, 10_485_760, 50), "HTML": Limits(10_485_760, 3_145_728, 10_485_760, 50)}


@dataclass
class Child:
    """A found object; no content: it could not be taken out (too big, encrypted, damaged)."""

    content: bytes | None
    relation: dict = field(default_factory=dict)
    force_type: str | None = None
    symbols: list[str] = field(default_factory=list)


@dataclass
class Result:
    metadata: dict = field(default_factory=dict)
    symbols: list[str] = field(default_factory=list)
    children: list[Child] = field(default_factory=list)
    error: str | None = None


@dataclass
class Job:
    content: bytes
    object_type: str
    symbols: tuple[str, ...] = ()
    passwords: tuple[str, ...] = ()
    limits: Limits = Limits()
    page: bytes | None = None  # of an address: what it leads to


REGISTRY: dict[str, Callable[[Job], Result]] = {}


def processor(*types: str) -> Callable:
    def register(f: Callable[[Job], Result]) -> Callable[[Job], Result]:
        for t in types:
            REGISTRY[t] = f
        return f

    return register


class Collector:
    """Children under the limits: what is too big stays without content, what is too much is left out and said so."""

    def __init__(self, job: Job) -> None:
        self.limits, self.children, self.symbols, self.left = job.limits, [], [], job.limits.total_bytes

    @property
    def full(self) -> bool:
        if len(self.children) >= self.limits.children:
            self._reached()
            return True
        return False

    def _reached(self) -> None:
        if "LIMITS_REACHED" not in self.symbols:
            self.symbols.append("LIMITS_REACHED")

    def add(self, content: bytes | None, relation: dict, force_type: str | None = None, symbols: list[str] | None = None) -> bool:
        if self.full:
            return False
        symbols = list(symbols or [])
        if content is not None and len(content) > min(self.limits.child_bytes, self.left):
            content = None
            symbols.append("TOOBIG")
            self._reached()
        if content is not None:
            self.left -= len(content)
        self.children.append(Child(content, relation, force_type, symbols))
        return True

    def cap(self) -> int:
        """Bytes that the next child may have at most; one more shows that it is too big."""
        return min(self.limits.child_bytes, self.left) + 1


def run(job: Job) -> Result:
    """Apply the processor of the job's type; any failure on the content is a permanent error of the object."""
    f = REGISTRY.get(job.object_type)
    if f is None:
        return Result()
    if len(job.content) > job.limits.input_bytes:
        return Result(error="input is too big")
    try:
        out = f(job)
    except Malformed as e:
        return Result(error=str(e) or "malformed input")
    except Exception as e:  # damaged input may break any library in any way
        return Result(error=f"{type(e).__name__}: {e}"[:500])
    out.symbols = sorted({clean_symbol(s) for s in out.symbols})
    out.metadata = clean_keys(drop_nulls(out.metadata))
    for c in out.children:
        c.relation = clean_keys(drop_nulls(c.relation))
        c.symbols = sorted({clean_symbol(s) for s in c.symbols})
    return out


def clean_symbol(s: str) -> str:
    return re.sub(r"[^A-Z0-9_]", "_", s.upper())


def drop_nulls(x: object) -> object:
    """Null members of objects are left out; nulls in lists stay."""
    if isinstance(x, dict):
        return {k: drop_nulls(v) for k, v in x.items() if v is not None}
    if isinstance(x, (list, tuple)):
        return [drop_nulls(v) for v in x]
    if isinstance(x, bytes):
        return x.hex()
    return x.replace("\x00", "") if isinstance(x, str) else x


def clean_keys(x: object) -> object:
    """Keys with blanks get underscores for all but letters, digits, _ and -; on collision the first stays."""
    if not isinstance(x, dict):
        return x
    out: dict = {}
    for k, v in x.items():
        k = k.replace("\x00", "")
        if " " in k:
            k = re.sub(r"[^A-Za-z0-9_-]", "_", k)
        if k not in out:
            out[k] = clean_keys(v)
    return out


class Reader:
    """Struct reads with bounds: beyond the end the input is malformed."""

    def __init__(self, data: bytes, order: str = "<", at: int = 0) -> None:
        self.data, self.order, self.at = data, order, at

    def get(self, fmt: str, at: int | None = None) -> tuple:
        s = struct.Struct(self.order + fmt)
        pos = self.at if at is None else at
        if pos < 0 or pos + s.size > len(self.data):
            raise Malformed("input ends too early")
        if at is None:
            self.at += s.size
        return s.unpack_from(self.data, pos)

    def one(self, fmt: str, at: int | None = None) -> int:
        return self.get(fmt, at)[0]

    def bytes(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Malformed("input ends too early")
        self.at += n
        return self.data[self.at - n:self.at]

    def fields(self, *spec: tuple[str, str]) -> dict:
        return {name: self.one(fmt) for name, fmt in spec}


def guid(raw: bytes) -> str:
    a, b, c = struct.unpack("<IHH", raw[:8])
    return f"{a:08X}-{b:04X}-{c:04X}-{raw[8:10].hex().upper()}-{raw[10:16].hex().upper()}"


def filetime(v: int) -> float | None:
    """Seconds since 1970 of a count of 100 ns since 1601; 0 is no time."""
    return v / 1e7 - 11644473600 if v else None
