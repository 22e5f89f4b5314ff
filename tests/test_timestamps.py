import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
import pytest

from nestlake.functions import zones
from nestlake.operators.timestamps import EPOCHS, _GRAMMAR, WIDTH, convert, normaliser
from nestlake.operators.timestamps_queries import SINCE, UNTIL

ZONES = ["Europe/Rome", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "UTC", "Australia/Lord_Howe"]


@pytest.fixture(scope="module")
def tables():
    return zones.Tables()


def one(text, zone, tables, *span):
    r = convert(pd.Series([text]), pd.Series([zone]), tables, *span).iloc[0]
    return r.status, None if pd.isna(r.instant) else r.instant.to_pydatetime()


def test_local_times_against_fold(tables):
    """Every half hour around all changes of some years, against both folds of the standard library."""
    texts, zs, expected = [], [], []
    for z in ZONES:
        info = ZoneInfo(z)
        for s in tables.get(z).starts[1:]:
            if s > 5_000_000_000:
                break
            base = datetime.fromtimestamp(int(s), UTC).replace(tzinfo=None) + timedelta(seconds=int(tables.get(z).offsets[-1]))
            if not 1900 <= base.year <= 2100:
                continue
            for k in range(-6, 7):
                local = base.replace(minute=0, second=0) + timedelta(minutes=30 * k, seconds=7)
                both = {(local.replace(tzinfo=info, fold=f) - local.replace(tzinfo=info, fold=f).utcoffset()).replace(tzinfo=None) for f in (0, 1)}
                valid = sorted(u for u in both if u.replace(tzinfo=UTC).astimezone(info).replace(tzinfo=None) == local)
                texts.append(local.strftime("%Y-%m-%d %H:%M:%S"))
                zs.append(z)
                expected.append(("nonexistent", "ok", "ambiguous")[len(valid)] if len(valid) != 1 else ("ok", valid[0]))
    got = convert(pd.Series(texts), pd.Series(zs), tables)
    for t, z, e, s, i in zip(texts, zs, expected, got.status, got.instant, strict=True):
        if isinstance(e, tuple):
            assert (s, i.to_pydatetime()) == e, (t, z)
        else:
            assert s == e, (t, z)


@pytest.mark.parametrize(("text", "zone", "expected"), [
    ("2020-07-01 12:00:00", "Europe/Rome", datetime(2020, 7, 1, 10)), ("2020-07-01T12:00:00.5Z", "Europe/Rome", datetime(2020, 7, 1, 12, 0, 0, 500000)),
    ("20200701T120000", None, datetime(2020, 7, 1, 12)), ("01.07.2020 12:00", "UTC", datetime(2020, 7, 1, 12)), ("07/01/2020 12:30:00 AM", "UTC", datetime(2020, 7, 1, 0, 30)),
    ("Wed, 01 Jul 2020 12:00:00 +0530", "UTC", datetime(2020, 7, 1, 6, 30)), ("2020-07-01 9:00:00.25 -05:00:00", "UTC", datetime(2020, 7, 1, 14, 0, 0, 250000)),
    ("2020-07-01 12:00:00 CEST", "Europe/Rome", datetime(2020, 7, 1, 10)), ("2020-07-01 12:00:00 IST", "Asia/Kolkata", datetime(2020, 7, 1, 6, 30)),
    ("1593604800", "UTC", datetime(2020, 7, 1, 12)), ("1593604800.25", "UTC", datetime(2020, 7, 1, 12, 0, 0, 250000)), ("1593604800123", "UTC", datetime(2020, 7, 1, 12, 0, 0, 123000)),
    ("1593604800123456", "UTC", datetime(2020, 7, 1, 12, 0, 0, 123456)), ("132380784000000000", "UTC", datetime(2020, 7, 1, 12)), (" 2020-07-01 ", "UTC", datetime(2020, 7, 1)),
])
def test_forms(text, zone, expected, tables):
    assert one(text, zone, tables, SINCE, UNTIL) == ("ok", expected)


def test_far_years(tables):
    assert one("1999-07-01 12:00:00", "America/New_York", tables) == ("ok", datetime(1999, 7, 1, 16))
    assert one("1995-06-01 12:00:00", "Europe/Berlin", tables) == ("ok", datetime(1995, 6, 1, 10))
    assert one("2005-04-03 02:30:00", "America/New_York", tables)[0] == "nonexistent"
    assert one("1999-10-31 01:30:00", "America/New_York", tables)[0] == "ambiguous"
    assert one("946684800", "UTC", tables)[0] == "several_epochs" and one("946684800", "UTC", tables, SINCE, UNTIL) == ("ok", datetime(2031, 1, 1))
    assert one("946684800", "UTC", tables, datetime(1995, 1, 1), datetime(2030, 1, 1)) == ("ok", datetime(2000, 1, 1))
    assert one("2011-12-30 12:00:00", "Pacific/Apia", tables)[0] == "nonexistent" and one("2400-07-01 12:00:00", "Europe/Rome", tables) == ("ok", datetime(2400, 7, 1, 10))
    assert one("2012-01-05 12:00:00 MSK", "Europe/Moscow", tables) == ("ok", datetime(2012, 1, 5, 8)) and one("2018-01-05 12:00:00 MSK", "Europe/Moscow", tables) == ("ok", datetime(2018, 1, 5, 9))
    assert one("2014-10-26 01:30:00 MSK", "Europe/Moscow", tables)[0] == "ambiguous" and one("2020-01-05 12:00:00 CEST", "Europe/Rome", tables) == ("ok", datetime(2020, 1, 5, 10))


def test_all_zones_as_in_the_standard_library(tables):
    """Offsets of all zones at random instants of 1970 to 2100, and around their changes of some years, and far ahead."""
    rng = random.Random(1)
    for z in sorted(tables.rules):
        t, info = tables.get(z), ZoneInfo(z)
        at = [rng.randrange(4_133_980_800) for _ in range(40)] + [rng.randrange(4_200_000_000, 200_000_000_000) for _ in range(10)]
        at += [int(s) + d for s in t.starts[1:] if 0 < s < 4_133_980_800 for d in (-1, 0)][-60:]
        got = t.offset_at(pd.Series(at).to_numpy())
        assert [int((datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=a)).astimezone(info).utcoffset().total_seconds()) for a in at] == got.tolist(), z


def test_no_form_is_wider_than_looked_at():
    longest = "a" * 12 + ", 99 aaa 9999 99:99:99." + "9" * 9 + " +99:99:99"
    assert any(g.match(longest) for g in _GRAMMAR) and len(longest) <= WIDTH
    assert not any("+" in g.pattern.replace("[+-]", "").replace("[.,]", "") for g in _GRAMMAR)


@pytest.mark.parametrize(("text", "zone", "status"), [
    (None, "UTC", "none"), ("", "UTC", "none"), ("0", "UTC", "none"), ("INVALID", None, "none"), ("2020-02-30 10:00:00", "UTC", "unparsed"), ("2020-13-01", "UTC", "unparsed"), ("x" * 5000, "UTC", "unparsed"),
    ("2020-07-01 12:00:00", "Mars/Base", "unknown_zone"), ("2020-07-01 12:00:00 XYZ", "UTC", "unparsed"), ("13/13/2020 01:00:00 AM", "UTC", "unparsed"), ("12345", "UTC", "unparsed"), ("٢٠٢٠-01-01", "UTC", "unparsed"),
])
def test_no_instant(text, zone, status, tables):
    assert one(text, zone, tables, SINCE, UNTIL) == (status, None)


def test_ranges_of_epochs_do_not_meet():
    spans = sorted(tuple(((x - datetime(1970, 1, 1)).total_seconds() - base) * ticks for x in (SINCE, UNTIL)) for _, ticks, base in EPOCHS)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_round_trip_of_random_instants(tables):
    rng = random.Random(3)
    for _ in range(200):
        u, z = datetime(2012, 1, 1) + timedelta(seconds=rng.randrange(600_000_000)), rng.choice(ZONES)
        local = u.replace(tzinfo=UTC).astimezone(ZoneInfo(z))
        off = local.strftime("%z")
        if len(off) == 5:
            assert one(local.strftime("%Y-%m-%dT%H:%M:%S") + off[:3] + ":" + off[3:], z, tables) == ("ok", u)


def test_spark_column(spark):
    at = normaliser()
    rows = spark.createDataFrame([("2020-03-29 02:30:00", "Europe/Rome"), ("2020-10-25 02:30:00", "Europe/Rome"), (None, None)], "x string, z string")
    assert [r.s.status for r in rows.select(at("x", "z").alias("s")).collect()] == ["nonexistent", "ambiguous", "none"]
    assert rows.where("x = ''").select(at("x", "z").alias("s")).count() == 0
