"""Functions of decimals, times, bitmaps, arrays and text over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import arrays, bitmaps, decimals, sql, texts, times
from millrace.plans.registry import query
from millrace.plans.series_queries import events, micros
from millrace.sources.tables import table


def cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct prices in whole cents, and quantities."""
    rows = table(spark, sf_dir, "lineitem").select(F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("c"), F.col("l_quantity").cast("bigint").alias("q"))
    return rows.distinct()


_CENTS = "d AS (SELECT DISTINCT CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(l_quantity AS BIGINT) AS q FROM lineitem)"


@query(f"""
WITH {_CENTS} SELECT c, q, regexp_replace(regexp_replace((c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0'), '0+$', ''), '[.]$', '') AS shown,
       format('{{:,}}', c // 100) || '.' || (c % 100 // 10) AS grouped, ((c + 5) // 10)::DOUBLE / 10 AS half_up, (c % 100)::DOUBLE / 100 AS frac,
       CASE WHEN c % 100 = 0 THEN 0 WHEN c % 10 = 0 THEN 1 ELSE 2 END AS places, sign(c - 100 * q * 1000)::INTEGER AS cmp, least(c, 100000 * q)::DOUBLE / 100 AS smaller, greatest(c, 100000 * q)::DOUBLE / 100 AS larger,
       -c::DOUBLE / 100 AS negative, CAST(NULL AS DOUBLE) AS junk FROM d""")
def decimal_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals read from text with needless zeros and digits, and what is shown and made of them."""
    typed = F.concat(F.lit("00"), F.expr("c div 100"), F.lit("."), F.lpad((F.col("c") % 100).cast("string"), 2, "0"), F.lit("0000000000000000007"))
    rows = cents(spark, sf_dir).withColumns({"v": decimals.parse(typed), "w": (F.col("q") * 1000).cast(decimals.KIND)})
    v, w = F.col("v"), F.col("w")
    return rows.select(
        "c", "q", decimals.text(v).alias("shown"), decimals.grouped(v, 1).alias("grouped"), decimals.round_half_up(v, 1).cast("double").alias("half_up"), decimals.frac(v).cast("double").alias("frac"), decimals.places(v).alias("places"),
        decimals.compare(v, w).alias("cmp"), decimals.smaller(v, w).cast("double").alias("smaller"), decimals.larger(v, w).cast("double").alias("larger"), (-v).cast("double").alias("negative"), decimals.parse(F.concat(typed, F.lit("x"))).cast("double").alias("junk"),
    )


@query(f"""
WITH {_CENTS} SELECT c, q, c // 100 AS units, c * 10000 AS fine, c * (q * 10 + 5) // 100 AS product, c * 100 // (q * 10 + 5) AS quotient, c::DOUBLE / 100 AS value,
       (c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS typed, c * 10 + q % 10 AS parsed FROM d""")
def fixed_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-point numbers of two places: rescaling, products and quotients with numbers of two places, text."""
    c, q = F.col("c"), F.col("q")
    typed = F.concat(F.expr("c div 100"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))
    other = q * 10 + 5
    return cents(spark, sf_dir).select(
        "c", "q", decimals.rescale(c, 2, 0).alias("units"), decimals.rescale(c, 2, 6).alias("fine"), decimals.fixed_multiply(c, other, 2).alias("product"), decimals.fixed_divide(c, other, 2).alias("quotient"),
        decimals.fixed_value(c, 2).cast("double").alias("value"), typed.alias("typed"), decimals.fixed_parse(F.concat(typed, (q % 10).cast("string"), F.lit("99")), 3).alias("parsed"),
    )


@query("""
SELECT l_orderkey, l_linenumber, isnan(CASE WHEN l_linenumber = 2 THEN 'nan'::DOUBLE ELSE l_tax END) AS missing, CASE WHEN l_linenumber = 2 THEN 0.0 ELSE l_tax END AS filled, true AS near, false AS far,
       lower(hex(l_partkey)) AS hexed, lpad(l_partkey::VARCHAR, 12, '0') AS padded, l_partkey AS back FROM lineitem""")
def number_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floats that may be missing or nearly equal, and whole numbers as hex and padded text."""
    key, price = F.col("l_partkey"), F.col("l_extendedprice")
    tax = F.when(F.col("l_linenumber") == 2, float("nan")).otherwise(F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.isnan(tax).alias("missing"), F.nanvl(tax, F.lit(0.0)).alias("filled"), decimals.nearly(price * 3 / 3, price).alias("near"), decimals.nearly(price * 1.0001, price).alias("far"),
        F.lower(F.hex(key)).alias("hexed"), F.lpad(key.cast("string"), 12, "0").alias("padded"), F.conv(F.hex(key), 16, 10).cast("bigint").alias("back"),
    )


@query("""
WITH e AS (SELECT event_id, epoch_us(ts) * 1000 + event_id % 1000 AS ns, ts FROM events)
SELECT event_id, ns // 1000000000 AS secs, ns AS dec, ns - 1600000000000000000 AS since, (ns % 1000000000) * 3 // 2 AS scaled, (ns % 1000000000) * 2 // 5 AS shared,
       strftime(ts, '%A') AS day_long, strftime(ts, '%b') AS month_short, strftime(ts, '%B') AS month_long, epoch_us(ts + INTERVAL 14 MONTH) * 1000 AS later,
       (epoch_us(date_trunc('day', ts)) // 1000000 + 9 * 3600 + 30 * 60 + 15 - 7200) * 1000000000 AS session, CAST(strftime(ts, '%H%M%S') AS INTEGER) * 1000 + CAST(floor(epoch_us(ts) / 1000) AS BIGINT) % 1000 AS millis,
       9 * 3600 AS ahead, ns AS back FROM e WHERE day(ts) <= 28""")
def time_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds, decimals, epochs, products and quotients, names, parts that overflow, session times, zones."""
    rows = events(spark, sf_dir, "event_id", "ts", (micros() * 1000 + F.col("event_id") % 1000).alias("ns")).where(F.day("ts") <= 28)
    ns, broken = F.col("ns"), F.pmod(F.col("ns"), F.lit(times.SECOND))
    parts = times.parts(ns)
    later = times.make(parts["year"], parts["month"] + 14, parts["day"], parts["hour"], parts["minute"], parts["second"], F.lit(0)) + broken - F.pmod(ns, F.lit(1000))
    return rows.select(
        "event_id", times.seconds(ns).alias("secs"), (times.as_decimal(ns) * F.lit(times.SECOND).cast("decimal(10,0)")).cast("bigint").alias("dec"), times.since(ns, 1_600_000_000_000_000_000).alias("since"), times.multiply(broken, F.lit("1.5").cast(decimals.KIND)).alias("scaled"),
        times.divide(broken, F.lit("2.5").cast(decimals.KIND)).alias("shared"), times.names(ns)["day_long"].alias("day_long"), times.names(ns)["month"].alias("month_short"), times.names(ns)["month_long"].alias("month_long"), later.alias("later"),
        times.session_time(F.to_date("ts"), F.lit(93015), 7200).alias("session"), times.hms_millis(ns).cast("bigint").alias("millis"), times.zone_offset(ns, "Asia/Tokyo").cast("int").alias("ahead"), times.from_decimal(times.as_decimal(ns)).alias("back"),
    )


@query("""
WITH e AS (SELECT event_id, CAST(event_id % 50 AS INTEGER) AS a, CAST(event_id % 50 + event_id % 7 AS INTEGER) AS b FROM events)
SELECT event_id, CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END AS shown, CAST(64 AS INTEGER) AS size, a + 1 <= b AS has, CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END || ',100-102' AS more, CAST(128 AS INTEGER) AS more_size,
       CASE WHEN b = a THEN '' WHEN b = a + 1 THEN b::VARCHAR ELSE (a + 1) || '-' || b END AS less, CASE WHEN b > a THEN a + 1 ELSE -1 END AS following, CASE WHEN b > a THEN b - 1 ELSE -1 END AS preceding,
       '00000001' || format('{:016x}', (((1::HUGEINT << (b - a + 1)::HUGEINT) - 1) << a::HUGEINT)::UBIGINT) AS sent, sign(b - 30)::INTEGER AS cmp FROM e""")
def bitmap_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitmaps read from ranges, changed, sent and compared."""
    n = F.col("event_id")
    rows = events(spark, sf_dir, "event_id").withColumns({"a": (n % 50).cast("int"), "b": (n % 50 + n % 7).cast("int")})
    a, b = F.col("a"), F.col("b")
    held = rows.withColumn("m", bitmaps.parse(F.concat(a.cast("string"), F.lit("-"), b.cast("string"))))
    m = F.col("m")
    more = bitmaps.set_range(m, F.lit(100), F.lit(103))
    one = bitmaps.of(F.array(F.when(b == 30, b).otherwise(F.lit(30))))
    return held.select(
        "event_id", bitmaps.text(m).alias("shown"), bitmaps.length(m).alias("size"), bitmaps.get(m, a + 1).alias("has"), bitmaps.text(more).alias("more"), bitmaps.length(more).alias("more_size"), bitmaps.text(bitmaps.clear_range(m, a, a + 1)).alias("less"),
        bitmaps.following(m, a).alias("following"), bitmaps.preceding(m, b).alias("preceding"), bitmaps.send(m).alias("sent"), bitmaps.compare(bitmaps.of(F.array(b)), one).alias("cmp"),
    )


@query("""
WITH o AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS v FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey)
SELECT l_orderkey, '[' || array_to_string(v, ', ') || ']' AS shown, v[2] AS second, v = [1, 2, 3] AS equal, '[' || array_to_string(list_concat(v, [9, 8]), ', ') || ']' AS longer,
       '[' || array_to_string(list_concat(list_concat(v[1:1], [7, 7]), v[3:]), ', ') || ']' AS spliced, '[' || array_to_string(list_reverse_sort(v), ', ') || ']' AS turned, coalesce(list_position(v, 3), 0)::BIGINT - 1 AS place FROM o""")
def array_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line numbers of each order as an array field."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("v"))
    v = F.col("v")
    whole = lambda *x: F.array(*[F.lit(i) for i in x])
    return rows.select(
        "l_orderkey", arrays.show(v).alias("shown"), arrays.element(v, F.lit(1)).alias("second"), (v == whole(1, 2, 3)).alias("equal"), arrays.show(F.concat(v, whole(9, 8))).alias("longer"), arrays.show(arrays.splice(v, 1, 1, whole(7, 7))).alias("spliced"),
        arrays.show(F.sort_array(v, asc=False)).alias("turned"), arrays.search(v, F.lit(3)).alias("place"),
    )


@query("""
SELECT p_partkey, substr(p_name, 1, 3) || '--' || substr(p_name, 6) AS spliced, rtrim(p_name) AS chomped, p_partkey % 4 < 2 AS truth, CASE WHEN p_partkey % 4 < 3 THEN p_partkey % 4 < 2 END AS strict,
       CASE WHEN p_partkey % 3 = 0 THEN 'XTKS:' || concat_ws('|', CASE WHEN p_size & 1 > 0 THEN 'Odd' END, CASE WHEN p_size & 4 > 0 THEN 'Four' END) WHEN p_partkey % 3 = 1 THEN 'XNAS:' || CASE WHEN p_size & 2 > 0 THEN 'Two' ELSE '' END END AS flags,
       octet_length(encode(p_name || 'é')) AS utf8, length(p_name) + 1 AS latin1, p_name || 'é' AS back, starts_with(p_name, 'p') AS starts, p_name < 'Part' AS before FROM part""")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splices, line ends, truth values, flags of venues, character sets and comparisons."""
    name, key = F.col("p_name"), F.col("p_partkey")
    word = F.element_at(F.array(*[F.lit(x) for x in ("Yes", "TRUE", "no", "perhaps")]), (key % 4 + 1).cast("int"))
    flags = {"XTKS": {"Odd": 0, "Four": 2}, "XNAS": {"Two": 1}}
    venue = F.element_at(F.array(F.lit("XTKS"), F.lit("XNAS"), F.lit("XLON")), (key % 3 + 1).cast("int"))
    accented = F.concat(name, F.lit("é"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", texts.splice(name, 3, 2, F.lit("--")).alias("spliced"), texts.chomp(F.concat(name, F.lit(" \r\n"))).alias("chomped"), texts.to_bool(word).alias("truth"), texts.to_bool(word, strict=True).alias("strict"),
        texts.venue_flags(venue, F.col("p_size"), flags).alias("flags"), F.octet_length(accented).alias("utf8"), F.octet_length(F.encode(accented, "ISO-8859-1")).alias("latin1"), F.decode(F.encode(accented, "ISO-8859-1"), "ISO-8859-1").alias("back"),
        name.startswith("p").alias("starts"), (name < "Part").alias("before"),
    )


@query("SELECT p_partkey, (p_partkey * 1000000000000000000::HUGEINT // 7)::VARCHAR AS seventh, length(p_name) AS width, p_name AS back FROM part")
def registered_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's functions called by name from SQL text."""
    sql.register(spark)
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return spark.sql(
        """SELECT p_partkey, CAST(decimal_divide(CAST(p_partkey AS DECIMAL(36,18)), CAST(7 AS DECIMAL(36,18))) AS STRING) AS seventh, display_width(p_name) AS width,
                  CAST(unbase32(base32(CAST(p_name AS BINARY))) AS STRING) AS back FROM {rows}""", rows=rows,
    ).withColumn("seventh", F.regexp_replace(F.regexp_replace("seventh", "[.]", ""), "^0+(?=.)", ""))
