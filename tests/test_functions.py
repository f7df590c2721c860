"""Functions on fixed cases: decimals, times, bitmaps, text."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.functions import bitmaps, decimals, texts, times


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def dec(x):
    return F.lit(x).cast(decimals.KIND)


@pytest.mark.parametrize("text, want", [("0", "0"), ("-42.010", "-42.01"), ("007.5", "7.5"), (".5", "0.5"), ("5.", "5"), ("1.2345678901234567891", "1.234567890123456789"), ("1 ", "1"), ("nan", "NaN"), ("x1", "NaN"), ("1234567890123456789", "NaN"), ("0x10", "NaN"), ("", "NaN"), ("-0.000000000000000001", "-0.000000000000000001"), ("999999999999999999.999999999999999999", "999999999999999999.999999999999999999")])
def test_decimal_text(spark, text, want):
    assert one(spark, decimals.text(decimals.parse(F.lit(text)))) == want


def test_decimal_arithmetic(spark):
    big = dec("999999999999999999.999999999999999999")
    got = one(
        spark, decimals.multiply(dec("1000"), dec("2")), decimals.multiply(dec("-0.333333333333333333"), dec("0.5")), decimals.multiply(big, dec("2")), decimals.divide(dec("2"), dec("-3")),
        decimals.divide(dec("1"), dec("0")), decimals.add(big, dec("0.000000000000000001")), decimals.floor(dec("-42.01")), decimals.round_half_up(dec("-2.5")), decimals.frac(dec("-42.01")),
        decimals.places(dec("3.1400")), decimals.smaller(dec("1"), F.lit(None).cast(decimals.KIND)), decimals.larger(dec("1"), dec("2")), decimals.compare(F.lit(None).cast(decimals.KIND), dec("-5")), decimals.truncate(dec("-1.999"), 2),
    )
    assert got == (Decimal(2000), Decimal("-0.166666666666666666"), None, Decimal("-0.666666666666666666"), None, None, Decimal(-42), Decimal(-3), Decimal("-0.01"), 2, None, Decimal(2), -1, Decimal("-1.99"))


def test_products_and_quotients_against_whole_numbers(spark):
    import random

    draw, shift = random.Random(1), 10**18
    number = lambda: draw.randint(-(10 ** draw.randint(1, 36)), 10 ** draw.randint(1, 36))
    rows = [(number(), number(), draw.randint(-(10**9), 10**9)) for _ in range(500)] + [(10**36 - 1, 10**36 - 1, 1), (1, 10**36 - 1, 7), (-(10**36) + 1, shift, -1), (5, 5, 0)]
    as_dec = lambda m: Decimal(f"{'-' if m < 0 else ''}{abs(m) // shift}.{abs(m) % shift:018}")
    df = spark.createDataFrame([(i, as_dec(a), as_dec(b), n) for i, (a, b, n) in enumerate(rows)], "i int, a decimal(36,18), b decimal(36,18), n long")
    cut = lambda a, b: (abs(a) // abs(b)) * (1 if (a < 0) == (b < 0) else -1)
    mantissa = lambda x: None if x is None else int(x.as_tuple().sign * -2 + 1) * int("".join(map(str, x.as_tuple().digits))) * 10 ** (x.as_tuple().exponent + 18)
    for r in df.select("i", decimals.multiply(F.col("a"), F.col("b")).alias("p"), decimals.divide_whole(F.col("a"), F.col("n")).alias("q")).collect():
        a, b, n = rows[r.i]
        product = cut(a * b, shift)
        assert mantissa(r.p) == (product if abs(product) < 10**36 else None)
        assert mantissa(r.q) == (cut(a, n) if n else None)


def test_fixed_point_text_and_nearness(spark):
    assert one(spark, decimals.fixed_parse(F.lit("-42.019"), 2), decimals.fixed_parse(F.lit("x"), 2), decimals.fixed_text(F.lit(-4201), 2), decimals.fixed_divide(F.lit(100), F.lit(300), 2), decimals.fixed_divide(F.lit(100), F.lit(0), 2)) == (-4201, None, "-42.01", 33, None)
    assert one(spark, decimals.nearly(F.lit(0.1) + 0.2, F.lit(0.3)), decimals.nearly(F.lit(1.0), F.lit(1.001)), decimals.nearly(F.lit(0.0), F.lit(0.0))) == (True, False, True)


def test_old_calendar(spark):
    days = lambda n: times.calendar(F.lit(n))
    assert [tuple(one(spark, days(n))) for n in (times.REFORMATION, times.REFORMATION - 1, 0, times.REFORMATION - 13)] == [(1752, 9, 14), (1752, 9, 2), (1970, 1, 1), (1752, 8, 21)]
    assert one(spark, times.multiply(F.lit(-3), dec("0.5")), times.divide(F.lit(10**9), dec("3")), times.divide(F.lit(1), dec("0"))) == (-1, 333_333_333, None)


def test_arrays_and_bitmap_order(spark):
    from millrace.functions import arrays

    v = F.array(F.lit(3), F.lit(None), F.lit(5))
    assert one(spark, arrays.show(v), arrays.element(v, F.lit(9)), arrays.element(v, F.lit(-1)), arrays.search(v, F.lit(5)), arrays.show(arrays.splice(v, 0, 2, F.array(F.lit(8))))) == ("[3, , 5]", None, None, 2, "[8, 5]")
    m = lambda text: bitmaps.parse(F.lit(text))
    assert one(spark, bitmaps.compare(m("0-5"), m("6")), bitmaps.compare(m("1,9"), m("0,9")), bitmaps.compare(m("3"), m("3"))) == (-1, 1, 0)


def test_decimal_aggregates(spark):
    df = spark.createDataFrame([(Decimal(1),), (None,), (Decimal(2),), (Decimal(5),), (Decimal(6),)], "x decimal(36,18)")
    assert df.agg(decimals.total(F.col("x")), decimals.mean(F.col("x"))).first() == (Decimal(14), Decimal("3.5"))
    assert df.where("x is null").agg(decimals.total(F.col("x")), decimals.mean(F.col("x"))).first() == (None, None)
    third = spark.createDataFrame([(Decimal(2),), (Decimal(0),), (Decimal(0),)], "x decimal(36,18)")
    assert third.agg(decimals.mean(F.col("x"))).first()[0] == Decimal("0.666666666666666666")


def test_fixed_point(spark):
    assert one(spark, decimals.rescale(F.lit(-4299), 2, 1), decimals.rescale(F.lit(42), 0, 3), decimals.fixed_multiply(F.lit(12345), F.lit(-15), 1), decimals.fixed_value(F.lit(-4201), 2)) == (-429, 42000, -18517, Decimal("-42.01"))


@pytest.mark.parametrize("text, want", [("1970/01/01 00:00:00", 0), ("2011/11/11 12:12:12.1234", 1321013532_123400000), ("2024-02-29T23:59:59.999999999Z", 1709251199_999999999), ("2024-01-01T01:00:00+01:00", 1704067200_000000000), ("2024-01-01T00:00:00-05:30", 1704087000_000000000), ("20240101-00:00:01.5", 1704067201_500000000), ("1969-12-31T23:59:59.5Z", -500000000), ("junk", None), ("2024-13-01 00:00:00", None)])
def test_time_text(spark, text, want):
    assert one(spark, times.parse(F.lit(text))) == want


def test_time_formats_and_arithmetic(spark):
    ns = lambda x: F.lit(x).cast("bigint")
    got = one(spark, times.format_iso(ns(0)), times.format_iso(ns(-500000000)), times.format_iso(ns(1704067200_000000001), 90), times.format_fix(ns(1704067201_500000000)), times.format_csv(ns(1321013532_123400000)))
    assert got == ("1970-01-01T00:00:00Z", "1969-12-31T23:59:59.5Z", "2024-01-01T01:30:00.000000001+01:30", "20240101-00:00:01.5", "2011/11/11 12:12:12.1234")
    got = one(spark, times.add(ns(1700000000_123456789), dec("0.000000001")), times.difference(ns(1700000000_123456789), ns(1700000000_000000000)), times.seconds(ns(-42_010000000)), times.from_decimal(dec("-42.01")), times.hms_millis(ns(1321013532_123400000)))
    assert got == (1700000000_123456790, Decimal("0.123456789"), -42, -42_010000000, 121212123)
    got = one(spark, times.make(F.lit(2023), F.lit(14), F.lit(30), F.lit(25), F.lit(61), F.lit(61), ns(5)), times.zone_offset(ns(1720000000_000000000), "Europe/Berlin"), times.session_time(F.lit("2024-01-02").cast("date"), F.lit(93015), 3600))
    assert got[1:] == (7200, 1704184215_000000000)
    assert one(spark, times.format_iso(F.lit(got[0]))) == "2024-03-02T02:02:01.000000005Z"
    week = one(spark, times.weeks(times.parse(F.lit("2021-01-03T00:00:00Z"))))
    assert (week.week_mon, week.week_sun, week.iso_year, week.iso_week, week.iso_day) == (0, 1, 2020, 53, 7)


@pytest.mark.parametrize("text, want, length", [("", "", 0), (",", "", 0), ("0-1,3-4,6,8-", "0-1,3-4,6,8-", 64), ("6,3-4,0,1", "0-1,3-4,6", 64), ("63", "63-", 64), ("100", "100", 128), ("-", None, None), ("-0", None, None), ("a", None, None)])
def test_bitmap_text(spark, text, want, length):
    m = bitmaps.parse(F.lit(text))
    assert one(spark, bitmaps.text(m), bitmaps.length(m)) == (want, length)


def test_bitmap_operations(spark):
    m, n = bitmaps.parse(F.lit("0-1,3-4,6,8-")), bitmaps.parse(F.lit("1-3,70"))
    assert one(spark, bitmaps.text(bitmaps.set_range(m, F.lit(60), F.lit(68))), bitmaps.text(bitmaps.clear_range(m, F.lit(1), F.lit(60)))) == ("0-1,3-4,6,8-67", "0,60-")
    assert one(spark, bitmaps.text(bitmaps.intersection(m, n)), bitmaps.text(bitmaps.union(bitmaps.parse(F.lit("5")), n)), bitmaps.text(bitmaps.difference(bitmaps.parse(F.lit("1,5")), n)), bitmaps.text(bitmaps.flip(n))) == ("1,3", "1-3,5,70", "2-3,5,70", "0,4-69,71-")
    assert one(spark, bitmaps.first(n), bitmaps.last(n), bitmaps.following(n, F.lit(3)), bitmaps.preceding(n, F.lit(1)), bitmaps.get(n, F.lit(70))) == (1, 70, 70, -1, True)
    assert one(spark, bitmaps.send(bitmaps.parse(F.lit("0,63,64")))) == "00000002" + "8000000000000001" + "0000000000000001"


def test_text(spark):
    t = F.lit
    got = one(spark, texts.camel(t("snake_case_name")), texts.snake(t("camelCaseName")), texts.quote_csv(t('a "b"')), texts.quote_c(t('a"\\\n')), texts.chomp(t("x \r\n")), texts.splice(t("abcdef"), 1, 2, t("XY")), texts.replace_first(t("a1b2"), r"([a-z])(\d)", "$2$1"))
    assert got == ("snakeCaseName", "camel_case_name", '"a ""b"""', '"a\\"\\\\\\n"', "x", "aXYdef", "1ab2")
    assert one(spark, texts.to_bool(t("YES")), texts.to_bool(t("2")), texts.to_bool(t("2"), True), texts.to_bool(t("No"), True)) == (True, False, None, False)
    assert one(spark, texts.base32(t(b"foobar")), texts.unbase32(t("MZXW6YTBOI")), texts.width(t("a字é"))) == ("MZXW6YTBOI", bytearray(b"foobar"), 4)
    names = {"Flag1": 0, "Flag2": 1, "P": 2}
    assert one(spark, texts.flag_names(t(5), names), texts.flag_value(t("P|Flag1|?"), names), texts.enum_value(t("Buy"), {"Buy": 0, "B": 0}), texts.enum_name(t(0), {"Buy": 0, "B": 0}), texts.enum_value(t("x"), {"Buy": 0})) == ("Flag1|P", 5, 0, "Buy", None)
    assert one(spark, texts.venue_flags(t("V"), t(2), {"V": {"a": 0, "b": 1}}), texts.venue_flags(t("W"), t(2), {"V": {"a": 0}})) == ("V:b", None)


def test_functions_in_sql(spark):
    from millrace.functions import sql

    sql.register(spark)
    row = spark.sql("SELECT decimal_multiply(CAST(1.5 AS DECIMAL(36, 18)), CAST(3 AS DECIMAL(36, 18))) AS p, decimal_divide(CAST(1 AS DECIMAL(36, 18)), CAST(3 AS DECIMAL(36, 18))) AS q, display_width('a字') AS w, base32(CAST('f' AS BINARY)) AS b").first()
    assert tuple(row) == (Decimal("4.5"), Decimal("0.333333333333333333"), 3, "MY")


def test_registered_functions_of_large_keys(spark, tmp_path):
    from millrace.plans import QUERIES

    keys = [0, 1, 700, 20_000, 10**12 + 1]
    spark.createDataFrame([(k, "a字") for k in keys], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: r.seventh for r in QUERIES["registered_functions"](spark, str(tmp_path)).collect()}
    assert got == {k: str(k * 10**18 // 7) for k in keys}
