"""Byte patterns: grammar, validation, identifying hash, and matching by regular expressions over bytes.

A pattern is one or more subsignatures of hexadecimal bytes, ``?`` for a nibble, ``(aa|bb)`` alternatives, ``!(..)``
negated ones, ``{n}`` any n bytes; subsignatures are parted by ``*`` (any gap), ``{n-m}`` or ``[n-m]`` gaps.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

_SPLIT = re.compile(r"\*|\{\d*-\d*\}|\[\d+-\d+\]")
_ITEM = re.compile(r"(?P<byte>[0-9a-f?]{2})|\{(?P<skip>\d+)\}|(?P<neg>!?)\((?P<alt>[^()]*)\)")


def _gap(token: str) -> str:
    if token == "*":
        return ".*"
    lo, hi = token[1:-1].split("-")
    if lo and hi and int(hi) < int(lo):
        raise ValueError(f"range {token}")
    return ".{%s,%s}" % (lo or 0, hi)


def _byte(b: str) -> str:
    if b == "??":
        return "."
    if b[1] == "?":
        return r"[\x%s0-\x%sf]" % (b[0], b[0])
    if b[0] == "?":
        return "[" + "".join(rf"\x{n:x}{b[1]}" for n in range(16)) + "]"
    return rf"\x{b}"


def _subsignature(text: str, beside_bracket: bool) -> str:
    out, at, run, longest = [], 0, 0, 0
    while at < len(text):
        m = _ITEM.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at:at + 4]!r}")
        at = m.end()
        if m["byte"]:
            out.append(_byte(m["byte"]))
            run = run + 1 if "?" not in m["byte"] else 0
            longest = max(longest, run)
            continue
        run = 0
        if m["skip"]:
            out.append(".{%s}" % m["skip"])
            continue
        parts = m["alt"].split("|")
        if not all(re.fullmatch(r"(?:[0-9a-f?]{2})+(?:\{\d+\}(?:[0-9a-f?]{2})+)*", p) for p in parts):
            raise ValueError("alternative")
        if m["neg"] and (len({len(p) for p in parts}) > 1 or any("?" in p or "{" in p for p in parts)):
            raise ValueError("negated alternatives must be static and of one length")
        any_of = "|".join("".join(_byte(x) if not x.startswith("{") else ".{%s}" % x[1:-1] for x in re.findall(r"\{\d+\}|..", p)) for p in parts)
        out.append("(?!%s).{%d}" % (any_of, len(parts[0]) // 2) if m["neg"] else f"(?:{any_of})")
    if longest < (1 if beside_bracket else 2):
        raise ValueError("each part needs two static bytes in a row")
    return "".join(out)


def parse_pattern(text: str) -> str:
    """The regular expression of a pattern; ValueError if it is not valid."""
    if not text:
        raise ValueError("empty")
    pieces, gaps = _SPLIT.split(text), _SPLIT.findall(text)
    out = ""
    for k, piece in enumerate(pieces):
        near = (gaps[k - 1] if k else "") + (gaps[k] if k < len(gaps) else "")
        out += _subsignature(piece, "[" in near) + (_gap(gaps[k]) if k < len(gaps) else "")
    return out


def identity(text: str, offset: str = "*") -> str:
    """Half a SHA-256 of target, offset and pattern: the tag by which a scanner marks matching objects."""
    return hashlib.sha256(f"0:{offset}:{text}".encode()).hexdigest()[:32]


def matches(content: bytes, text: str, offset: str = "*") -> bool:
    return _found(content, re.compile(parse_pattern(text).encode("latin-1"), re.S), offset)


class Scanner:
    """Looks for many patterns in a content. A pattern's longest run of static bytes is looked for first, which settles
    most of them without its expression."""

    def __init__(self, tags: dict[str, tuple[str, str]]) -> None:
        """tags: tag -> (pattern, offset)."""
        self.tags = [(t, re.compile(parse_pattern(p).encode("latin-1"), re.S), o, _static(p)) for t, (p, o) in sorted(tags.items())]

    def tags_of(self, content: bytes) -> list[str]:
        return [t for t, rx, offset, static in self.tags if static in content and _found(content, rx, offset)]


def tags(patterns: Iterable[tuple[str, str]], prefix: str = "Pattern.") -> dict[str, tuple[str, str]]:
    """The tags by which queries know patterns (text, offset)."""
    return {prefix + identity(p, o): (p, o) for p, o in patterns}


def _static(pattern: str) -> bytes:
    """Longest run of plain bytes that every match holds."""
    bare = re.sub(r"!?\([^()]*\)|\{[^}]*\}|\[[^\]]*\]|\*", " ", pattern)
    runs = [w for part in bare.split() for w in re.findall(r"(?:[0-9a-f]{2})+", re.sub(r"(..)", lambda m: "  " if "?" in m[1] else m[1], part))]
    return bytes.fromhex(max(runs, key=len, default=""))


def _found(content: bytes, rx: re.Pattern, offset: str) -> bool:
    if offset == "*":
        return rx.search(content) is not None
    at = len(content) - int(offset[4:]) if offset.startswith("EOF-") else int(offset)
    return at >= 0 and rx.match(content, at) is not None
