"""Times as BIGINT nanoseconds since 1970-01-01 UTC, as Columns.

Spark's timestamps stop at microseconds, so the nanoseconds are carried apart
and timestamps made only for calendars and formats, which are Gregorian; for days
before 14 September 1752 ``calendar`` has the Julian date.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import decimals

SECOND = 1_000_000_000
DECIMAL = "decimal(36,18)"


def _div(a: Column, b: int) -> Column:
    """a / b rounded down."""
    return F.call_function("div", a - F.pmod(a, F.lit(b).cast("bigint")), F.lit(b).cast("bigint"))


def timestamp(ns: Column) -> Column:
    """The timestamp that holds the instant, cut to microseconds."""
    return F.timestamp_micros(_div(ns, 1000))


def from_timestamp(ts: Column) -> Column:
    return F.unix_micros(ts) * F.lit(1000).cast("bigint")


def parse(text: Column) -> Column:
    """Text to nanoseconds: YYYY/MM/DD HH:MM:SS[.n], YYYY-MM-DDTHH:MM:SS[.n][Z or offset], YYYYMMDD-HH:MM:SS[.n]; else null."""
    pattern = r"^\s*(\d{4})[/-]?(\d{2})[/-]?(\d{2})[ T-](\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,9})\d*)?\s*(Z|[+-]\d{2}:?\d{2})?\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    plain = F.concat_ws("-", part(1), part(2), part(3))
    ts = F.try_to_timestamp(F.concat(plain, F.lit(" "), F.concat_ws(":", part(4), part(5), part(6))), F.lit("yyyy-MM-dd HH:mm:ss"))
    digits = F.rpad(part(7), 9, "0").cast("bigint")
    zone = F.regexp_replace(part(8), ":", "")
    minutes = F.when(zone.isin("", "Z"), F.lit(0)).otherwise(
        F.when(zone.startswith("-"), -1).otherwise(1) * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int"))
    )
    return F.when(text.rlike(pattern), F.unix_seconds(ts) * F.lit(SECOND).cast("bigint") + digits - minutes.cast("bigint") * F.lit(60 * SECOND).cast("bigint"))


def _fraction(ns: Column) -> Column:
    """The digits after the second, with a point, without needless zeros."""
    digits = F.regexp_replace(F.lpad(F.pmod(ns, F.lit(SECOND)).cast("string"), 9, "0"), "0+$", "")
    return F.when(digits == "", "").otherwise(F.concat(F.lit("."), digits))


def format_csv(ns: Column) -> Column:
    return F.concat(F.date_format(timestamp(ns), "yyyy/MM/dd HH:mm:ss"), _fraction(ns))


def format_iso(ns: Column, offset_minutes: int = 0) -> Column:
    """ISO 8601, in UTC with Z or at a fixed offset."""
    local = ns + F.lit(offset_minutes * 60 * SECOND).cast("bigint")
    zone = "Z" if not offset_minutes else f"{'-' if offset_minutes < 0 else '+'}{abs(offset_minutes) // 60:02d}:{abs(offset_minutes) % 60:02d}"
    return F.concat(F.date_format(timestamp(local), "yyyy-MM-dd'T'HH:mm:ss"), _fraction(ns), F.lit(zone))


def format_fix(ns: Column) -> Column:
    return F.concat(F.date_format(timestamp(ns), "yyyyMMdd-HH:mm:ss"), _fraction(ns))


def add(ns: Column, seconds: Column) -> Column:
    """The instant some decimal seconds later, to the nanosecond."""
    return ns + (seconds.cast("decimal(28,9)") * F.lit(SECOND)).cast("bigint")


def difference(a: Column, b: Column) -> Column:
    """a - b in decimal seconds."""
    return (((a - b).cast("decimal(20,0)")) * F.lit("0.000000001").cast("decimal(9,9)")).cast(DECIMAL)


def multiply(ns: Column, by: Column) -> Column:
    """A span of nanoseconds times a decimal, cut toward nought."""
    return (decimals.truncate(decimals.multiply(as_decimal(ns), by), 9) * F.lit(SECOND).cast("decimal(10,0)")).cast("decimal(38,0)").try_cast("bigint")


def divide(ns: Column, by: Column) -> Column:
    """A span of nanoseconds over a decimal, cut toward nought; by nought is null."""
    return (decimals.truncate(decimals.divide(as_decimal(ns), by), 9) * F.lit(SECOND).cast("decimal(10,0)")).cast("decimal(38,0)").try_cast("bigint")


def seconds(ns: Column) -> Column:
    """Whole seconds, toward nought."""
    return F.call_function("div", ns, F.lit(SECOND).cast("bigint"))


def as_decimal(ns: Column) -> Column:
    return difference(ns, F.lit(0).cast("bigint"))


def from_decimal(value: Column) -> Column:
    return add(F.lit(0).cast("bigint"), value)


def since(ns: Column, epoch_ns: int) -> Column:
    """Nanoseconds since an epoch, as a frame's index."""
    return ns - F.lit(epoch_ns).cast("bigint")


def ymd(ns: Column) -> Column:
    return F.date_format(timestamp(ns), "yyyyMMdd").cast("int")


def hms(ns: Column) -> Column:
    return F.date_format(timestamp(ns), "HHmmss").cast("int")


def hms_millis(ns: Column) -> Column:
    return F.date_format(timestamp(ns), "HHmmssSSS").cast("int")


def parts(ns: Column) -> Column:
    """year, month, day, hour, minute, second, nano."""
    ts = timestamp(ns)
    return F.struct(
        F.year(ts).alias("year"), F.month(ts).alias("month"), F.day(ts).alias("day"), F.hour(ts).alias("hour"), F.minute(ts).alias("minute"),
        F.second(ts).alias("second"), F.pmod(ns, F.lit(SECOND)).alias("nano"),
    )


#: The first Gregorian day, 14 September 1752, as a day since 1970, and the Julian day number of 1970.
REFORMATION, JULIAN_1970 = -79366, 2440588


def calendar(days: Column) -> Column:
    """year, month, day of a day since 1970: Gregorian from 14 September 1752 on, Julian before."""
    date = F.date_from_unix_date(days.cast("int"))
    div = lambda a, b: F.floor(a / b)
    c = days + JULIAN_1970 + 32082
    y = div(4 * c + 3, 1461)
    e = c - div(1461 * y, 4)
    m = div(5 * e + 2, 153)
    old = days < REFORMATION
    return F.struct(
        F.when(old, y - 4800 + div(m, 10)).otherwise(F.year(date)).cast("int").alias("year"), F.when(old, m + 3 - 12 * div(m, 10)).otherwise(F.month(date)).cast("int").alias("month"),
        F.when(old, e - div(153 * m + 2, 5) + 1).otherwise(F.day(date)).cast("int").alias("day"),
    )


def weeks(ns: Column) -> Column:
    """Weeks of the year from Monday and from Sunday (both 0 before the first such day), and ISO year, week and day."""
    ts = timestamp(ns)
    doy, monday = F.dayofyear(ts), F.weekday(ts)
    return F.struct(
        F.floor((doy + 6 - monday) / 7).cast("int").alias("week_mon"), F.floor((doy + 6 - F.pmod(monday + 1, F.lit(7))) / 7).cast("int").alias("week_sun"),
        F.extract(F.lit("YEAROFWEEK"), ts).alias("iso_year"), F.weekofyear(ts).alias("iso_week"), (monday + 1).alias("iso_day"),
    )


def names(ns: Column) -> Column:
    ts = timestamp(ns)
    return F.struct(*[F.date_format(ts, f).alias(n) for n, f in (("day", "EEE"), ("day_long", "EEEE"), ("month", "MMM"), ("month_long", "MMMM"))])


def make(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, nano: Column) -> Column:
    """An instant from parts that may overflow, which carry into the next."""
    months = year * 12 + (month - 1)
    first = F.make_date(F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1))
    days = F.unix_date(first) + day - 1
    return ((days.cast("bigint") * 24 + hour) * 60 + minute) * F.lit(60 * SECOND).cast("bigint") + second.cast("bigint") * F.lit(SECOND).cast("bigint") + nano


def zone_offset(ns: Column, zone: str) -> Column:
    """Seconds that the zone is ahead of UTC at the instant."""
    ts = timestamp(ns)
    return F.unix_seconds(F.from_utc_timestamp(ts, zone)) - F.unix_seconds(ts)


def session_time(date: Column, hhmmss: Column, offset_seconds: int = 0) -> Column:
    """The instant of a number HHMMSS on a date, in a zone ``offset_seconds`` ahead of UTC."""
    clock = F.floor(hhmmss / 10000) * 3600 + F.pmod(F.floor(hhmmss / 100), F.lit(100)) * 60 + F.pmod(hhmmss, F.lit(100))
    return (F.unix_date(date).cast("bigint") * 86400 + clock - offset_seconds) * F.lit(SECOND).cast("bigint")
