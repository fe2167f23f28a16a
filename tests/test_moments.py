from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from kinweave.functions.moments import to_utc, zone_intervals


def utc(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp())


CASES = [
    ("2021-01-04T02:55:12.327Z", "Europe/London", utc(2021, 1, 4, 2, 55, 12)),
    ("Fri, 01 Apr 2022 05:12:21 -0400", "Asia/Tokyo", utc(2022, 4, 1, 9, 12, 21)),
    ("Fri, 01 Apr 2022 23:07:22 +0200 (CET)", "Asia/Tokyo", utc(2022, 4, 1, 21, 7, 22)),
    ("Fri, 01 Mar 2024 14:48:28 -0800 (UTC-08:00)", "UTC", utc(2024, 3, 1, 22, 48, 28)),
    ("Fri, 01 Apr 2022 12:11:16 CDT", "UTC", utc(2022, 4, 1, 17, 11, 16)),
    ("10 Apr 24 10:02 +0100", "UTC", utc(2024, 4, 10, 9, 2)),
    ("01.01.2022 04:21", "Europe/Ljubljana", utc(2022, 1, 1, 3, 21)),
    ("9.12.2021, 2:03", "UTC", utc(2021, 12, 9, 2, 3)),
    ("Apr 10, 2021 4:58 PM", "America/New_York", utc(2021, 4, 10, 20, 58)),
    ("Apr 1, 2021 12:07 AM", "UTC", utc(2021, 4, 1, 0, 7)),
    ("2021-01-07T03:00:05[Asia/Kolkata]", "UTC", utc(2021, 1, 6, 21, 30, 5)),
    ("20210104T091433Z", "UTC", utc(2021, 1, 4, 9, 14, 33)),
    ("2021-01-01 22:46:28.529875+1100", "UTC", utc(2021, 1, 1, 11, 46, 28)),
    ("2021/01/04 16:59:08.304585", "UTC", utc(2021, 1, 4, 16, 59, 8)),
    ("1609613789", "Asia/Tokyo", 1609613789),
    ("1609770145988", "Asia/Tokyo", 1609770145),
    ("1610230532071708", "UTC", 1610230532),
    ("2021-01-01", "America/New_York", utc(2021, 1, 1, 5)),
    # the clock shows 02:30 twice: the first; 02:30 is skipped: the offset before the change
    ("2021-10-31 02:30:00", "Europe/Ljubljana", utc(2021, 10, 31, 0, 30)),
    ("2021-03-28 02:30:00", "Europe/Ljubljana", utc(2021, 3, 28, 1, 30)),
    ("2021-11-07 01:30:00", "America/New_York", utc(2021, 11, 7, 5, 30)),
    ("2020-02-29 00:00:00", "UTC", utc(2020, 2, 29)),
    *[(x, "UTC", None) for x in (None, "", "  ", "--", "yesterday", "2023-13-04T09:00:00Z", "2024-02-30 10:15:00", "31.04.2023 12:00", "Mon, 99 Foo 2024 25:61:00 +0000", "0000-00-00 00:00:00", "NaT", "n/a", "x" * 5000)],
    ("2021-01-01 10:00:00", "Nowhere/Land", None),
    ("2021-01-01 10:00:00", None, None),
    ("2021-01-01T10:00:00Z", None, utc(2021, 1, 1, 10)),
]


def test_moments(spark):
    df = spark.createDataFrame([(i, t, z) for i, (t, z, _) in enumerate(CASES)], "i int, date string, tz string")
    got = {r.i: r.utc_second for r in to_utc(df, "date", "tz").collect()}
    assert [(c[0], got[i]) for i, c in enumerate(CASES)] == [(c[0], c[2]) for c in CASES]


def test_any_year_is_read_by_the_clock_of_its_zone(spark):
    """Years without bound: before the first change of a clock, and after the years that are listed."""
    years = [(f"{y:04}-{m:02}-15 10:00:00", z) for y in (1, 1599, 1799, 1850, 1899, 2101, 2128, 2129, 2150, 2200, 2400, 2999, 9998) for m in (1, 3, 7, 11) for z in ("Europe/Berlin", "America/New_York", "Asia/Kolkata", "Africa/Casablanca", "Australia/Sydney")]
    df = spark.createDataFrame([(i, t, z) for i, (t, z) in enumerate(years)], "i int, date string, tz string")
    got = {r.i: r.utc_second for r in to_utc(df, "date", "tz").collect()}
    for i, (t, z) in enumerate(years):
        local = datetime.fromisoformat(t).replace(tzinfo=ZoneInfo(z))
        want = (local.replace(tzinfo=None) - datetime(1970, 1, 1)).total_seconds() - local.utcoffset().total_seconds()
        assert got[i] == int(want), (t, z)


def test_status(spark):
    rows = [("2021-10-31 02:30", "twice"), ("2021-03-28 02:30", "skipped"), ("2021-06-01 02:30", "once"), ("2021-06-01T02:30Z", "offset"), ("1609613789", "count"), (" ", "blank"), (None, "blank"), ("2021-13-01", "impossible"), ("soon", "no date"), ("2021-06-01T02:30[No/Where]", "impossible")]
    df = spark.createDataFrame([(t, "Europe/Berlin", want) for t, want in rows], "date string, tz string, want string")
    assert to_utc(df, "date", "tz", status="how").where("NOT how <=> want").count() == 0


def test_empty_repeated_and_extra_columns(spark):
    shape = "id long, date string, tz string, utc string, year int"
    assert to_utc(spark.createDataFrame([], shape), "date", "tz").count() == 0
    twice = spark.createDataFrame([(1, "2021-01-01", "UTC", "x", 3)] * 2, shape)
    out = to_utc(twice, "date", "tz")
    assert out.count() == 2 and out.columns == ["id", "date", "tz", "utc", "year", "utc_second"]


@pytest.mark.parametrize("zone", ["Europe/Ljubljana", "America/New_York", "Australia/Sydney", "Asia/Kathmandu", "Africa/Casablanca"])
def test_intervals_hold_the_zone_rules(zone):
    z = ZoneInfo(zone)
    for a, b, off in zone_intervals(zone):
        for t in (max(a, utc(1000, 1, 1)), b - 1):
            assert datetime.fromtimestamp(t, timezone.utc).astimezone(z).utcoffset().total_seconds() == off


def test_brute_force_over_a_change(spark):
    z, rows = ZoneInfo("Europe/London"), []
    for day in ("2022-03-27", "2022-10-30"):
        for m in range(0, 240, 7):
            local = datetime.fromisoformat(day).replace(hour=m // 60, minute=m % 60)
            rows.append((local.strftime("%Y-%m-%d %H:%M:%S"), "Europe/London", int(local.replace(tzinfo=z, fold=0).timestamp())))
    df = spark.createDataFrame(rows, "date string, tz string, want long")
    assert to_utc(df, "date", "tz").where(F.col("want") != F.col("utc_second")).count() == 0
