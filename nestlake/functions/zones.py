"""Zone transition tables: for each zone the instants at which its offset changes, over the whole range of its rules.

The driver reads the compiled rules (TZif, RFC 8536) of all zones as bytes, less than a megabyte, and sends them with
the tasks, so that every executor converts by the same version; a zone's table is made where the zone first occurs.
What the recurring rule at the end of a file says is written out for one Gregorian cycle of 400 years and repeats
after that, so no year is out of range.
"""

from __future__ import annotations

import functools
import re
import struct
import zoneinfo
from datetime import date
from importlib import resources
from pathlib import Path

import numpy as np

#: Days repeat with weekdays and leap years after so many seconds.
CYCLE = 146_097 * 86_400
_FIRST = -(2**60)


def version() -> str:
    """Version of the zone rules in use, as far as the system tells it."""
    for base in zoneinfo.TZPATH:
        for name in ("tzdata.zi", "+VERSION"):
            f = Path(base, name)
            if f.exists():
                return f.read_text(errors="replace").splitlines()[0].removeprefix("# version ").strip()
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


class Zone:
    """Segment n holds from starts[n] (UTC seconds, ascending) to starts[n + 1]: its offset and abbreviation."""

    def __init__(self, starts: np.ndarray, offsets: np.ndarray, abbreviations: np.ndarray, folds_at: int) -> None:
        self.starts, self.offsets, self.abbreviations, self.folds_at = starts, offsets, abbreviations, folds_at

    def _folded(self, t: np.ndarray) -> np.ndarray:
        """Times beyond the written-out cycle, moved into it by whole cycles."""
        return t - np.maximum(-(-(t - self.folds_at) // CYCLE), 0) * CYCLE

    def segment(self, utc: np.ndarray) -> np.ndarray:
        return np.maximum(np.searchsorted(self.starts, self._folded(utc), "right") - 1, 0)

    def offset_at(self, utc: np.ndarray) -> np.ndarray:
        return self.offsets[self.segment(utc)]

    def resolve(self, local: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Local seconds -> (first, last UTC seconds, number of instants); first and last mean nothing where that is 0."""
        # No zone is more than a day from UTC, so only the segments within two days of the local time can hold it.
        lo, hi = self.segment(local - 2 * 86400), self.segment(local + 2 * 86400)
        hi = np.where(hi < lo, len(self.starts) - 1, hi)  # the end of the cycle lies between
        first, last, count = np.full(len(local), 2**62), np.full(len(local), -(2**62)), np.zeros(len(local), np.int64)
        for step in range(int((hi - lo).max(initial=0)) + 1):
            k = np.minimum(lo + step, hi)
            utc = local - self.offsets[k]
            good = (lo + step <= hi) & (self.segment(utc) == k)
            first, last = np.where(good, np.minimum(first, utc), first), np.where(good, np.maximum(last, utc), last)
            count += good
        return np.where(count > 0, first, local), np.where(count > 0, last, local), count

    def resolve_named(self, local: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """As resolve, for a local time that comes with an abbreviation of this zone; None if the zone never used it.
        Where the abbreviation does not hold at that time of the year, the offset it last stood for is taken."""
        bearing = np.nonzero(self.abbreviations == name)[0]
        if not len(bearing):
            return None
        near = self.offsets[bearing[np.maximum(np.searchsorted(self.starts[bearing], self._folded(local), "right") - 1, 0)]]
        first, last, count = np.full(len(local), 2**62), np.full(len(local), -(2**62)), np.zeros(len(local), np.int64)
        for offset in np.unique(self.offsets[bearing]):
            utc = local - offset
            at = self.segment(utc)
            good = (self.offsets[at] == offset) & (self.abbreviations[at] == name)
            first, last = np.where(good, np.minimum(first, utc), first), np.where(good, np.maximum(last, utc), last)
            count += good
        return np.where(count > 0, first, local - near), np.where(count > 0, last, local - near), np.maximum(count, 1)


# ---- compiled rules

def _times(data: bytes) -> tuple[list[int], list[tuple[int, str]], str]:
    """(transition times, (offset, abbreviation) before the first and from each on, rule behind the last)."""
    head = ">4sc15x6l"
    size = struct.calcsize(head)
    _, v, isut, isstd, leap, n, types, chars = struct.unpack(head, data[:size])
    at, width = size, 4
    if v >= b"2":
        at += n * 5 + types * 6 + chars + leap * 8 + isstd + isut
        _, _, isut, isstd, leap, n, types, chars = struct.unpack(head, data[at:at + size])
        at, width = at + size, 8
    when = list(struct.unpack(f">{n}{'q' if width == 8 else 'l'}", data[at:at + n * width]))
    kind = data[at + n * width:at + n * (width + 1)]
    at += n * (width + 1)
    info = [struct.unpack(">lbB", data[at + 6 * k:at + 6 * k + 6]) for k in range(types)]
    at += 6 * types
    text = data[at:at + chars]
    named = [(off, text[k:text.index(b"\0", k)].decode("ascii")) for off, _, k in info]
    rule = data[at + chars + leap * (width + 4) + isstd + isut:].strip(b"\n").decode("ascii") if width == 8 else ""
    return when, [named[k] for k in (0, *kind)], rule


_NAME, _OFFSET = r"(?:<([^>]+)>|([A-Za-z]+))", r"([+-]?\d+(?::\d+){0,2})"
_RULE = re.compile(rf"{_NAME}{_OFFSET}(?:{_NAME}{_OFFSET}?,([^,]+),([^,]+))?$")


def _clock(text: str) -> int:
    parts = [int(x) for x in text.lstrip("+-").split(":")]
    return (-1 if text.startswith("-") else 1) * sum(x * u for x, u in zip(parts, (3600, 60, 1), strict=False))


def _day(spec: str, year: int) -> int:
    """Seconds from 1970 to the local moment that a rule names, as if local time were UTC."""
    day, _, clock = spec.partition("/")
    first = date(year, 1, 1).toordinal()
    if day[0] == "M":
        m, week, weekday = map(int, day[1:].split("."))
        start = date(year, m, 1)
        n = start.toordinal() + (weekday - start.isoweekday()) % 7 + 7 * (week - 1)
        after = date(year + m // 12, m % 12 + 1, 1).toordinal()
        n -= 7 if n >= after else 0
    elif day[0] == "J":  # 29 February is never counted
        leap = date(year, 12, 31).toordinal() - first == 365
        n = first + int(day[1:]) - 1 + (leap and int(day[1:]) >= 60)
    else:
        n = first + int(day)
    return (n - date(1970, 1, 1).toordinal()) * 86400 + (_clock(clock) if clock else 7200)


def _build(data: bytes) -> Zone:
    when, states, rule = _times(data)
    starts = [_FIRST, *when]
    m = _RULE.match(rule)
    folds_at = 2**62
    if m:
        standard = (-_clock(m[3]), m[1] or m[2])
        if m[7]:
            summer = (-_clock(m[6]) if m[6] else standard[0] + 3600, m[4] or m[5])
            last = when[-1] if when else 0
            year = 1970 + last // 31_556_952 - 1
            coming = sorted(x for y in range(year, year + 405) for x in ((_day(m[7], y) - standard[0], summer), (_day(m[8], y) - summer[0], standard)))
            for t, state in coming:
                if t > last:
                    starts.append(t)
                    states.append(state)
            folds_at = int(coming[-1][0]) - 366 * 86400
        elif states[-1] != standard:
            starts.append(when[-1] + 1 if when else 0)
            states.append(standard)
    return Zone(np.array(starts, np.int64), np.array([s[0] for s in states], np.int64), np.array([s[1].upper() for s in states], object), folds_at)


@functools.cache
def compiled() -> dict[str, bytes]:
    """Compiled rules of all named zones."""
    out = {}
    for name in zoneinfo.available_timezones():
        found = next((p for p in (Path(base, name) for base in zoneinfo.TZPATH) if p.is_file()), None)
        out[name] = found.read_bytes() if found else resources.files("tzdata").joinpath("zoneinfo", name).read_bytes()
    return out


class Tables:
    """Zones by name, each made when first asked for."""

    def __init__(self, rules: dict[str, bytes] | None = None) -> None:
        self.rules, self.made = compiled() if rules is None else rules, {}

    def get(self, name: str) -> Zone | None:
        if name not in self.made:
            self.made[name] = _build(self.rules[name]) if name in self.rules else None
        return self.made[name]

    def __reduce__(self):
        return Tables, (self.rules,)
