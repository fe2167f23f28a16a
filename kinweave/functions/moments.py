"""Text dates of many formats and zones to one UTC second.

Two steps. `with_clock` parses a text into a civil clock reading (seconds since 1970 as if the clock were UTC), and into
the offset or zone the text itself names. `to_utc` resolves readings without an offset by an as-of join to the intervals
in which a zone keeps one offset: one matching interval gives the offset, two mean an ambiguous reading (the first
occurrence is taken), none a skipped one (read with the offset before the change).
"""

from __future__ import annotations

import bisect
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names by their first three letters, and abbreviations of zones with minutes east of UTC.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ZONE_ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "met": 60, "mest": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "npt": 345, "jst": 540, "kst": 540, "aest": 600, "aedt": 660, "acst": 570,
    "acdt": 630, "awst": 480, "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360,
    "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}

#: Years for which the offsets of a zone are listed. No zone's clock changed before 1800, so the first offset holds for all
#: earlier years; after LAST_YEAR every zone follows a yearly rule, so a year takes the offsets of the one among the last
#: 28 listed that begins on the same weekday and is as long.
FIRST_YEAR, LAST_YEAR = 1800, 2128

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?"
_OFFSET = r"(Z|z|[A-Za-z]{2,5}|(?:UTC|GMT)?[+-]\d{2}:?\d{2}|(?:UTC|GMT)?[+-]\d{2})"
_TAIL = rf"(?:\s*{_OFFSET})?(?:\s*\[([^\]]+)\])?(?:\s*\([^)]*\))?"
#: Whole patterns of the forms of a date, and where year|month|day|hour|minute|second|half|offset|zone stand in them.
YEAR_FIRST = (rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:(?:\s*T\s*|\s+){_TIME}{_TAIL})?$", "$1|$3|$4|$5|$6|$7||$8|$9")
COMPACT = (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,]\d+)?{_TAIL}$", "$1|$2|$3|$4|$5|$6||$7|$8")
DOTTED = (rf"^(\d{{1,2}})\.\s*(\d{{1,2}})\.\s*(\d{{4}}|\d{{2}})(?:,?\s+{_TIME}{_TAIL})?$", "$3|$2|$1|$4|$5|$6||$7|$8")
DAY_MONTH = (rf"^(?:[A-Za-z]{{3,9}}\.?,?\s+)?(\d{{1,2}})[\s-]+([A-Za-z]{{3,9}})\.?,?[\s-]+(\d{{4}}|\d{{2}})(?:,?\s+{_TIME}{_TAIL})?$", "$3|$2|$1|$4|$5|$6||$7|$8")
MONTH_DAY = (rf"^([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+{_TIME}\s*(?:([AaPp])\.?[Mm]\.?)?{_TAIL})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9")
#: Digits of a count since 1970 and how many of its units make a second.
EPOCHS = [(9, 10, 1), (12, 13, 1_000), (15, 16, 1_000_000), (18, 19, 1_000_000_000)]


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, or null where there is no such day."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    good = (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= last)
    return F.when(good, _civil(y, m, d))


def _civil(y: Column, m: Column, d: Column) -> Column:
    yy = F.when(m <= 2, y - 1).otherwise(y)
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return yy * 365 + F.floor(yy / 4) - F.floor(yy / 100) + F.floor(yy / 400) + doy - 719468


def with_clock(df: DataFrame, text: str) -> DataFrame:
    """df with _epoch, _clock, _year, _offset and _zone read from the column named text.

    _epoch: UTC second where the text is a count since 1970. _clock: the seconds since 1970 that the wall clock shows.
    _offset: seconds east of UTC that the text names. _zone: an IANA name in brackets. All are null where the text is null,
    blank, impossible (13th month, 30 February, hour 25) or merely descriptive ("yesterday"). Fractions of a second are
    dropped, missing seconds are 0, a day alone means its 00:00.

    One character test picks the form, so that a row meets one whole pattern.
    """
    s, at = F.col("_s"), lambda i: F.substring("_s", i, 1)
    digit = at(1).between("0", "9")
    form = lambda f: F.regexp_replace(s, f[0], f[1])
    parts = (
        F.when(digit & ((at(2) == ".") | (at(3) == ".")), form(DOTTED))
        .when(digit & at(5).isin("-", "/", "."), form(YEAR_FIRST))
        .when(digit & (at(9) == "T"), form(COMPACT))
        .when(digit & ~F.contains(s, F.lit(" ")) & ~F.contains(s, F.lit("-")), None)
        .when(~digit & s.rlike(r"^[A-Za-z]{3,9}\.?\s+\d"), F.when(s.rlike(MONTH_DAY[0]), form(MONTH_DAY)).otherwise(form(DAY_MONTH)))
        .otherwise(form(DAY_MONTH))
    )
    out = df.withColumn("_s", F.trim(F.col(text), F.lit(" \t\r\n ")))
    out = out.withColumn("_p", F.split(parts, r"\|"))
    out = out.withColumn("_p", F.when(F.size("_p") == 9, F.col("_p")))
    num = lambda i: F.expr(f"try_cast(get(_p, {i}) AS INT)")
    part = lambda i: F.get("_p", F.lit(i))
    year = F.when(F.length(part(0)) == 2, num(0) + F.when(num(0) < 70, 2000).otherwise(1900)).otherwise(num(0))
    month = F.coalesce(num(1), F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(part(1), 1, 3))).cast("int"), F.lit(0)))
    half = F.lower(part(6))
    hour = F.when(part(3) == "", 0).when(half == "", num(3)).when(num(3).between(1, 12), num(3) % 12 + F.when(half == "p", 12).otherwise(0))
    minute, second = F.when(part(4) == "", 0).otherwise(num(4)), F.when(part(5) == "", 0).otherwise(num(5))
    count, digits = F.expr("try_cast(_s AS DECIMAL(30, 9))"), F.length(F.ltrim(F.substring_index("_s", ".", 1), F.lit("-")))
    epoch = F.lit(None).cast("long")
    for least, most, unit in EPOCHS:
        epoch = F.when(digits.between(least, most), F.floor(count / unit).cast("long")).otherwise(epoch)
    out = out.select(*df.columns, F.when(F.col("_p").isNull() & ~F.contains(s, F.lit(" ")), epoch).alias("_epoch"), year.alias("_year"), month.alias("_month"), num(2).alias("_day"), hour.alias("_hour"), minute.alias("_minute"), second.alias("_second"), F.upper(part(7)).alias("_off"), F.nullif(F.trim(part(8)), F.lit("")).alias("_zone"))
    o = F.col("_off")
    # "+05:30", "UTC+05:30", "-0330": sign, two digits of hours, two of minutes
    bare = F.translate(o, "UTCGM:", "")
    hours, minutes = F.expr("try_cast(substring(translate(_off, 'UTCGM:', ''), 2, 2) AS INT)"), F.expr("coalesce(try_cast(nullif(substring(translate(_off, 'UTCGM:', ''), 4, 2), '') AS INT), 0)")
    signed = F.when((hours <= 15) & (minutes <= 59), F.when(bare.startswith("-"), -1).otherwise(1) * (hours * 3600 + minutes * 60))
    letters = F.create_map(*[F.lit(x) for k, v in ZONE_ABBREVIATIONS.items() for x in (k.upper(), v * 60)])
    offset = F.when(o == "", None).when(F.right(o, F.lit(1)).between("0", "9"), signed).otherwise(F.try_element_at(letters, o))
    out = out.select(*df.columns, "_epoch", "_year", "_month", "_day", "_hour", "_minute", "_second", "_zone", (o == "").alias("_plain"), offset.alias("_offset"))
    y, m, d = F.col("_year"), F.col("_month"), F.col("_day")
    good = (F.col("_plain") | F.col("_offset").isNotNull()) & F.col("_hour").between(0, 23) & F.col("_minute").between(0, 59) & F.col("_second").between(0, 59)
    clock = F.when(good, _days(y, m, d).cast("long") * 86400 + F.col("_hour") * 3600 + F.col("_minute") * 60 + F.col("_second"))
    return out.select(*df.columns, "_epoch", clock.cast("long").alias("_clock"), "_year", "_offset", "_zone")


#: A second before any date.
BEGINNING = -(10**15)


def listed_year(year: Column) -> Column:
    """The listed year that has the same offsets at the same times of the year."""
    leap = lambda y: y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    alike = {2 * datetime(y, 1, 1).weekday() + leap(y): y for y in range(LAST_YEAR - 27, LAST_YEAR + 1)}
    long = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    # 1970 began on a Thursday
    weekday = F.pmod(_civil(year, F.lit(1), F.lit(1)) + 3, F.lit(7))
    later = F.get(F.array(*[F.lit(alike[k]) for k in range(14)]), (2 * weekday + long.cast("int")).cast("int"))
    return F.when(year > LAST_YEAR, later).otherwise(F.greatest(year, F.lit(FIRST_YEAR)))


@lru_cache(maxsize=1024)
def zone_intervals(zone: str) -> tuple[tuple[int, int, int], ...]:
    """(first UTC second, end, offset) of each interval in which the zone keeps one offset, over FIRST_YEAR..LAST_YEAR."""
    z = ZoneInfo(zone)
    at = lambda t: int((datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=t)).astimezone(z).utcoffset().total_seconds())
    first = int(datetime(FIRST_YEAR - 1, 12, 30, tzinfo=timezone.utc).timestamp())
    last = int(datetime(LAST_YEAR + 1, 1, 3, tzinfo=timezone.utc).timestamp())
    out, since, t, off, step = [], BEGINNING, first, at(first), 6 * 86400
    while t < last:
        if (new := at(t + step)) != off:
            k = t + bisect.bisect_left(range(1, step + 1), True, key=lambda x: at(t + x) != off) + 1
            out.append((since, k, off))
            since, t, off = k, k, at(k)
        else:
            t += step
    return (*out, (since, last, off))


_TABLES: dict[tuple, DataFrame] = {}


def interval_table(spark, zones: list[str]) -> DataFrame:
    """One row per zone and local year: the intervals that a clock reading of that year can fall in, in order of time.

    At most 599 zones times 329 years, each with a few intervals: the size bound of the broadcast. The table of the zones
    last asked for is kept, since all queries of a data folder ask for the same.
    """
    asked = (spark.sparkContext.applicationId, *zones)
    if asked not in _TABLES:
        _TABLES.clear()
        _TABLES[asked] = _interval_table(spark, zones)
    return _TABLES[asked]


def _interval_table(spark, zones: list[str]) -> DataFrame:
    rows = []
    for zone in zones:
        spans = zone_intervals(zone)
        starts = [a + off for a, _, off in spans]
        for year in range(FIRST_YEAR, LAST_YEAR + 1):
            lo = int(datetime(year, 1, 1, tzinfo=timezone.utc).timestamp())
            hi = int(datetime(year + 1, 1, 1, tzinfo=timezone.utc).timestamp())
            i, j = max(0, bisect.bisect_right(starts, lo) - 2), bisect.bisect_left(starts, hi) + 1
            rows.append((zone, year, [(a + off, b + off, off) for a, b, off in spans[i:j]]))
    return spark.createDataFrame(rows, "_zone_key string, _zone_year int, _spans array<struct<ls:bigint,le:bigint,off:int>>")


def known_zones(named: list[str]) -> dict[str, str]:
    """Each name that means an IANA zone, with the zone's own spelling."""
    own = {z.lower(): z for z in available_timezones()}
    return {x: own[x.strip().lower()] for x in named if x and x.strip().lower() in own}


def to_utc(df: DataFrame, text: str, default_zone: str, out: str = "utc_second", defaults: DataFrame | None = None, status: str | None = None) -> DataFrame:
    """df with the column out: UTC second of the text date, null where it names no moment.

    default_zone names the column with the IANA zone that holds where the text has neither offset nor zone. Columns of df
    keep their names and order; defaults may give all values of default_zone as a table of that one column; names starting
    with an underscore followed by a letter are reserved. An unknown zone in the text or in default_zone makes such rows
    null. Duplicated rows stay; an empty df gives an empty result; any year from 1 to 9999 is read.

    status names a further column: how the moment was found (`count` since 1970, `offset` in the text, `once`, `twice` or
    `skipped` by the clock of the zone) or why there is none (`blank`, `no date`, `impossible`).
    """
    clocked = with_clock(df, text)
    zones = known_zones(_zones_in(df, text, df.select(default_zone) if defaults is None else defaults))
    spark = df.sparkSession
    table = interval_table(spark, sorted(set(zones.values())))
    alias = spark.createDataFrame([(k, v) for k, v in zones.items()], "_named string, _zone_key string")
    spans = F.broadcast(alias.join(F.broadcast(table), "_zone_key").drop("_zone_key"))
    wanted = F.when(F.col("_clock").isNotNull() & F.col("_offset").isNull(), F.coalesce("_zone", F.col(default_zone)))
    keyed = clocked.withColumns({"_named": wanted, "_zone_year": listed_year(F.col("_year"))})
    joined = keyed.join(spans, ["_named", "_zone_year"], "left")
    shift = (_civil(F.col("_year"), F.lit(1), F.lit(1)) - _civil(F.col("_zone_year"), F.lit(1), F.lit(1))).cast("long") * 86400
    clock = F.col("_clock") - F.when(F.col("_year") > LAST_YEAR, shift).otherwise(0)
    joined = joined.withColumn("_like", clock)
    hits = F.filter("_spans", lambda x: (x.ls <= F.col("_like")) & (F.col("_like") < x.le))
    before = F.filter("_spans", lambda x: x.le <= F.col("_like"))
    offset = F.coalesce(F.col("_offset"), F.get(hits, F.lit(0)).off, F.when(F.size(before) > 0, F.try_element_at(before, F.lit(-1)).off))
    found = F.coalesce("_epoch", F.col("_clock") - offset)
    columns = [*df.columns, found.alias(out)]
    if status:
        by_clock = F.when(F.size(hits) == 1, "once").when(F.size(hits) > 1, "twice").otherwise("skipped")
        known = F.when(F.col("_epoch").isNotNull(), "count").when(F.col("_offset").isNotNull(), "offset").otherwise(by_clock)
        lacking = F.when(F.coalesce(F.trim(F.col(text), F.lit(" \t\r\n\u00a0")), F.lit("")) == "", "blank").when(F.col("_year").isNull(), "no date").otherwise("impossible")
        columns.append(F.when(found.isNotNull(), known).otherwise(lacking).alias(status))
    return joined.select(*columns)


def _zones_in(df: DataFrame, text: str, defaults: DataFrame) -> list[str]:
    """The distinct names of known zones in the data: no more than there are spellings of the IANA's 599 names."""
    own = sorted(z.lower() for z in available_timezones())
    bracket = df.select(text).where(F.contains(F.col(text), F.lit("["))).select(F.regexp_extract(text, r"\[([^\]]+)\]", 1).alias("z"))
    found = defaults.toDF("z").distinct().unionByName(bracket.distinct()).distinct()
    return [r.z for r in found.where(F.lower(F.trim("z")).isin(own)).collect()]
