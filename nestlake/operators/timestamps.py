"""Mixed timestamp texts -> one instant each, or the reason why there is none.

Texts are tokenised into shape masks (digits become 9, letters a). Each distinct mask of a batch is compiled once to a
parser, that is to character positions of its fields, and all texts of that mask are converted together by numpy.
Local times go through transition tables of the whole range of the zone rules (``functions.zones``), all of the
driver's version.

Statuses: ``ok``; ``none`` (null, blank, 0, INVALID); ``ambiguous`` (the local time occurred twice; the instant column
holds null, first and last instant are in ``earliest``/``latest``); ``nonexistent`` (it never occurred);
``several_epochs`` (a number that several epochs put between ``since`` and ``until``; earliest and latest as above);
``unparsed`` (no known shape, no calendar date, unknown abbreviation, or a number outside every epoch's range);
``unknown_zone`` (zone-less text whose zone name does not exist).

Defined results: text without zone is local time of its zone, null or blank zone means UTC; an explicit offset always
gives one instant, and so does a zone abbreviation (of the text's zone, else UTC/GMT/Z) unless the zone changed its
offset and kept the name; dotted dates have the day first, slashed ones the month; a second of 60 is the next minute's
first; a date without time is its midnight. Only bare numbers are held against ``since`` and ``until``; dates may be of
any year from 1 to 9999.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from nestlake.functions import zones

#: No text of the grammar below is longer, since each of its parts is bounded; longer ones need not be looked at.
WIDTH = 80
# Month names of RFC 2822 and of ctime, in order.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
# Known epochs as (name, ticks per second, seconds from 1970 to the epoch).
EPOCHS = (
    ("unix_s", 1, 0), ("unix_ms", 10**3, 0), ("unix_us", 10**6, 0), ("unix_ns", 10**9, 0),
    ("filetime_100ns", 10**7, -11644473600), ("webkit_us", 10**6, -11644473600),
    ("mac1904_s", 1, -2082844800), ("cocoa2001_s", 1, 978307200), ("ticks0001_100ns", 10**7, -62135596800),
)
#: Bare numbers are taken for instants of these years, unless the caller knows better.
SINCE, UNTIL = datetime(1970, 1, 1), datetime(2101, 1, 1)
SCHEMA = "instant timestamp_ntz, status string, earliest timestamp_ntz, latest timestamp_ntz"

_TIME = r"(?P<h>99?):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9{1,9}))?)?"
_ZONE = r"(?: ?(?P<off>[+-]99:?99(?::99)?|[+-]99)| ?(?P<abbr>a{1,5}))?"
_GRAMMAR = [re.compile(f"^{g}$") for g in (
    rf"(?P<y>9999)[-](?P<mo>99)[-](?P<d>99)(?:(?P<sep>[a ]){_TIME}{_ZONE})?",
    rf"(?P<y>9999)(?P<mo>99)(?P<d>99)(?P<sep>[a ])(?P<h>99)(?P<mi>99)(?:(?P<s>99)(?:[.,](?P<f>9{{1,9}}))?)?{_ZONE}",
    rf"(?P<d>99?)[.](?P<mo>99?)[.](?P<y>9999)(?: {_TIME}{_ZONE})?",
    rf"(?P<mo>99?)/(?P<d>99?)/(?P<y>9999)(?:,? {_TIME} ?(?P<half>aa))?",
    rf"(?P<mo>99?)/(?P<d>99?)/(?P<y>9999),? {_TIME}{_ZONE}",
    rf"(?:a{{1,12}}, ?)?(?P<d>99?) (?P<mon>a{{3}}) (?P<y>9999) {_TIME}{_ZONE}",
    rf"a{{3}} (?P<mon>a{{3}}) {{1,2}}(?P<d>99?) {_TIME} (?P<y>9999)",
    r"(?P<n>9{1,19})(?:[.](?P<f>9{1,9}))?",
)]
_CLASS = np.full(128, ord("?"), np.uint8)
_CLASS[0] = 0
_CLASS[32:127] = np.arange(32, 127)
_CLASS[ord("0"):ord("9") + 1] = ord("9")
for _a in ("az", "AZ"):
    _CLASS[ord(_a[0]):ord(_a[1]) + 1] = ord("a")


@functools.lru_cache(maxsize=4096)
def parser_of(mask: str) -> dict[str, tuple[int, int]] | None:
    """Field positions of a mask, or None: every distinct mask is looked at once per process."""
    for g in _GRAMMAR:
        if m := g.match(mask):
            half = m.span("half") if "half" in g.groupindex else (-1, -1)
            return {k: m.span(k) for k, v in m.groupdict().items() if v is not None} | ({"half": half} if half[0] >= 0 else {})
    return None


def _digits(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    n = np.zeros(len(chars), np.int64)
    for c in range(*span):
        n = n * 10 + (chars[:, c].astype(np.int64) - 48)
    return n


def _letters(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    part = np.ascontiguousarray(chars[:, span[0]:span[1]])
    return np.char.upper(part.view(f"U{span[1] - span[0]}").ravel())


def _micros(chars: np.ndarray, at: dict) -> np.ndarray:
    if "f" not in at:
        return np.zeros(len(chars), np.int64)
    a, b = at["f"]
    n = _digits(chars, (a, min(b, a + 6)))
    return n * 10 ** (6 - min(b - a, 6))


def _epoch(chars: np.ndarray, at: dict, span: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Earliest and latest microseconds since 1970 that an epoch gives within the span (seconds), and how many do."""
    whole, frac = _digits(chars, at["n"]), _micros(chars, at)
    first, last, count = np.full(len(whole), 2**62), np.full(len(whole), -(2**62)), np.zeros(len(whole), np.int64)
    for _, ticks, base in EPOCHS:
        lo, hi = (max(min((s - base) * ticks, 2**63 - 1), -(2**63)) for s in span)
        hit = (whole >= lo) & (whole < hi)
        us = (whole // ticks + base) * 10**6 + (whole % ticks) * 10**6 // ticks + frac // ticks
        first, last = np.where(hit, np.minimum(first, us), first), np.where(hit, np.maximum(last, us), last)
        count += hit
    return np.where(count > 0, first, 0), np.where(count > 0, last, 0), count


def _calendar(chars: np.ndarray, at: dict) -> tuple[np.ndarray, np.ndarray]:
    """Local seconds since 1970 and validity."""
    y, d = _digits(chars, at["y"]), _digits(chars, at["d"])
    if "mon" in at:
        names = _letters(chars, at["mon"])
        mo = np.zeros(len(chars), np.int64)
        for k, name in enumerate(MONTHS, 1):
            mo[names == name] = k
    else:
        mo = _digits(chars, at["mo"])
    h, mi, s = (_digits(chars, at[k]) if k in at else np.zeros(len(chars), np.int64) for k in ("h", "mi", "s"))
    ok = (mo >= 1) & (mo <= 12) & (d >= 1) & (mi < 60) & (s <= 60) & (y >= 1)
    if "half" in at:
        half = _letters(chars, at["half"])
        ok &= np.isin(half, ("AM", "PM")) & (h >= 1) & (h <= 12)
        h = h % 12 + 12 * (half == "PM")
    ok &= h < 24
    if "sep" in at:
        ok &= np.isin(chars[:, at["sep"][0]], [ord(x) for x in " Tt"])
    month = (y - 1970) * 12 + np.where(ok, mo, 1) - 1
    days = month.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + d - 1
    ok &= (month + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) > days
    return days * 86400 + h * 3600 + mi * 60 + s, ok


def convert(text: pd.Series, zone: pd.Series, tables: zones.Tables, since: datetime = SINCE, until: datetime = UNTIL) -> pd.DataFrame:
    """Vectorised core: one batch of texts with their zones."""
    n = len(text)
    span = tuple(int((x - datetime(1970, 1, 1)).total_seconds()) for x in (since, until))
    raw = text.where(text.notna(), "").astype(str).str.strip()
    us, late = np.zeros(n, np.int64), np.zeros(n, np.int64)
    status = np.full(n, "unparsed", object)
    status[(raw == "").to_numpy() | raw.str.upper().isin(["INVALID", "NULL", "NONE", "N/A"]).to_numpy() | raw.str.fullmatch(r"0+(?:\.0+)?").to_numpy()] = "none"
    long = raw.str.len().to_numpy() > WIDTH
    chars_all = np.ascontiguousarray(raw.to_numpy(dtype=f"U{WIDTH}")).view(np.uint32).reshape(n, WIDTH) if n else np.zeros((0, WIDTH), np.uint32)
    masks, which = np.unique(np.where(chars_all < 128, _CLASS[np.minimum(chars_all, 127)], ord("?")).astype(np.uint8).view(f"S{WIDTH}").ravel(), return_inverse=True)
    zname = zone.where(zone.notna(), "UTC").astype(str).str.strip().replace("", "UTC").to_numpy()
    for k, mask in enumerate(masks):
        at = parser_of(mask.decode("ascii"))
        if at is None:
            continue
        rows = np.nonzero((which == k) & ~long & (status != "none"))[0]
        if not len(rows):
            continue
        chars = chars_all[rows]
        if "n" in at:
            us[rows], late[rows], count = _epoch(chars, at, span)
            status[rows] = np.array(["unparsed", "ok", "several_epochs"], object)[np.minimum(count, 2)]
            continue
        local, ok = _calendar(chars, at)
        micros = _micros(chars, at)
        if "off" in at:
            a, b = at["off"]
            sign = np.where(chars[:, a] == ord("-"), -1, 1)
            pieces = [(a + 1, a + 3)] + [(p, p + 2) for p in range(a + 3 + (mask[a + 3:a + 4] == b":"), b - 1, 3)]
            shift = sum(_digits(chars, p) * u for p, u in zip(pieces, (3600, 60, 1), strict=False))
            us[rows] = late[rows] = (local - sign * shift) * 10**6 + micros
            status[rows[ok]] = "ok"
            continue
        names = _letters(chars, at["abbr"]) if "abbr" in at else None
        for z in set(zname[rows]):
            own = zname[rows] == z
            t = tables.get(z)
            for name in (None,) if names is None else set(names[own]):
                mine = own if name is None else own & (names == name)
                if name is None:
                    found = t.resolve(local[mine]) if t else None
                else:
                    found = t.resolve_named(local[mine], name) if t else None
                    if found is None and name in ("Z", "UTC", "GMT", "UT"):
                        found = local[mine], local[mine], np.ones(mine.sum(), np.int64)
                if found is None:
                    status[rows[mine & ok]] = "unknown_zone" if name is None else "unparsed"
                    continue
                first, last, count = found
                us[rows[mine]], late[rows[mine]] = first * 10**6 + micros[mine], last * 10**6 + micros[mine]
                status[rows[mine]] = np.where(ok[mine], np.array(["nonexistent", "ok", "ambiguous"], object)[np.minimum(count, 2)], "unparsed")
    stamp = pd.Series(us.view("datetime64[us]"))
    last = pd.Series(late.view("datetime64[us]"))
    known = np.isin(status, ("ok", "ambiguous", "several_epochs"))
    return pd.DataFrame({"instant": stamp.where(status == "ok"), "status": status, "earliest": stamp.where(known), "latest": last.where(known)})


def normaliser(since: datetime = SINCE, until: datetime = UNTIL) -> Callable[[Column, Column], Column]:
    """Pandas UDF (text, zone) -> struct of SCHEMA, carrying the driver's zone rules. ``since`` and ``until``: between
    which instants bare numbers lie, so far as that is known."""
    tables = zones.Tables()

    @F.pandas_udf(SCHEMA)
    def to_instant(text: pd.Series, zone: pd.Series) -> pd.DataFrame:
        return convert(text, zone, tables, since, until)

    return to_instant
