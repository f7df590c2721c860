"""Keyed tables, changes, joins, telemetry, CSV and functions over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from millrace.functions import bitmaps, decimals, texts, times
from millrace.operators import keyed, market
from millrace.operators import orders as orders_
from millrace.plans.registry import query, shared_path
from millrace.plans.series_queries import events, micros
from millrace.sources import tables
from millrace.sources.tables import table
from millrace.spec import KeySpec, TableSpec

ORDERS = TableSpec(
    "orders",
    (
        KeySpec(("o_orderkey",)),
        KeySpec(("o_orderpriority", "o_orderdate", "o_orderkey"), 1, frozenset({"o_orderdate"})),
        KeySpec(("o_custkey", "o_orderkey"), 1, frozenset({"o_orderkey"})),
    ),
    mutable=("o_totalprice", "o_orderstatus"),
)


def orders(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    found = table(spark, sf_dir, "orders")
    return found.select(*columns) if columns else found


# -- keyed selection


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7 LIMIT 1")
def find_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.find(orders(spark, sf_dir, "o_orderkey", "o_custkey", "o_totalprice"), ORDERS, 0, [7])


@query("SELECT l_orderkey AS o_orderkey, l_linenumber, l_partkey, o_totalprice FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def find_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return keyed.find_many(orders(spark, sf_dir, "o_orderkey", "o_totalprice"), probes, ORDERS, 0, "left")


@query("SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def select_rows_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.select_rows(orders(spark, sf_dir, "o_orderkey", "o_orderdate", "o_orderpriority"), ORDERS.keys[1], ["1-URGENT"], 50)


_PAGE = "WITH p AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 1 OFFSET 19) SELECT o.o_orderpriority, o.o_orderdate, o.o_orderkey FROM orders o, p WHERE o.o_orderpriority = '1-URGENT' AND (o.o_orderdate < p.o_orderdate OR o.o_orderdate = p.o_orderdate AND o.o_orderkey {} p.o_orderkey) ORDER BY o.o_orderdate DESC, o.o_orderkey LIMIT 25"


def _page(spark: SparkSession, sf_dir: str, inclusive: bool) -> DataFrame:
    rows = orders(spark, sf_dir, "o_orderpriority", "o_orderdate", "o_orderkey")
    last = keyed.select_keys(rows, ORDERS.keys[1], ["1-URGENT"], 20).collect()[-1]
    return keyed.select_keys(rows, ORDERS.keys[1], ["1-URGENT"], 25, [last.o_orderdate, last.o_orderkey], inclusive)


@query(_PAGE.format(">"))
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after the 20th row."""
    return _page(spark, sf_dir, False)


@query(_PAGE.format(">="))
def keyset_page_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, True)


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.group_counts(orders(spark, sf_dir), ORDERS.keys[1])


_TOP = "SELECT o_custkey, o_orderkey, o_totalprice, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS place FROM orders) WHERE place <= "


@query(_TOP + "1")
def top1_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.top_per_group(orders(spark, sf_dir, "o_custkey", "o_orderkey", "o_totalprice"), ORDERS.keys[2])


@query(_TOP + "3")
def top3_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.top_per_group(orders(spark, sf_dir, "o_custkey", "o_orderkey", "o_totalprice"), ORDERS.keys[2], 3)


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS INTEGER) AS count_so_far FROM orders")
def result_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.with_result_count(orders(spark, sf_dir, "o_custkey", "o_orderkey"), ORDERS.keys[2])


@query("SELECT event_id, coalesce(CASE WHEN event_id % 5 <> 0 THEN value END, -1.0) AS value, 'none' AS note FROM events")
def with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    return keyed.with_defaults(rows, {"value": -1.0, "note": "none"})


# -- changes


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir, "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", F.lit(0).cast("long").alias("_un"), F.lit(0).cast("long").alias("_vn"))


@query("""
SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, 0 AS _un, 0 AS _vn FROM orders
UNION ALL SELECT o_orderkey + 1000000000, o_custkey, 1.0, 'N', 5, 0 FROM orders""")
def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New orders; those of existing or repeated keys are rejected."""
    stored = _stored(spark, sf_dir)
    fresh = orders(spark, sf_dir, (F.col("o_orderkey") + 1_000_000_000).alias("o_orderkey"), "o_custkey")
    again = orders(spark, sf_dir).select("o_orderkey", F.lit(-1).cast("long").alias("o_custkey"))
    new = fresh.unionByName(again).withColumns({"o_totalprice": F.lit(1.0), "o_orderstatus": F.lit("N"), "_un": F.lit(5).cast("long")})
    return keyed.insert(stored, new, ORDERS)[0]


@query("""
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 6 = 0 THEN 2 WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 THEN 3 ELSE 0 END AS _un,
       CASE WHEN o_orderkey % 6 = 0 THEN 2 WHEN o_orderkey % 3 < 2 THEN 1 ELSE 0 END AS _vn FROM orders""")
def update_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes with nulls that keep, resets that clear, and keys that don't exist."""
    stored = _stored(spark, sf_dir)
    none = F.array().cast("array<string>")
    kind = lambda where, price, status, un, reset=none: stored.where(where).select("o_orderkey", price.cast("double").alias("o_totalprice"), status.cast("string").alias("o_orderstatus"), F.lit(un).cast("long").alias("_un"), reset.alias("_reset"))
    changes = (
        kind("o_orderkey % 3 = 0", F.col("o_totalprice") + 1, F.lit(None), 1)
        .unionByName(kind("o_orderkey % 6 = 0", F.lit(None), F.lit("Y"), 2, F.array(F.lit("o_orderstatus"))))
        .unionByName(kind("o_orderkey % 3 = 1", F.lit(None), F.lit("X"), 3))
        .unionByName(kind("o_orderkey % 9 = 4", F.lit(1.0), F.lit("Z"), 4).withColumn("o_orderkey", -F.col("o_orderkey") - 1))
    )
    return keyed.update(stored, changes, ORDERS)[0]


@query("""
SELECT o_orderkey, 0 AS _un, 0 AS _vn, false AS gone FROM orders WHERE o_orderkey % 4 <> 1
UNION ALL SELECT o_orderkey, 9, -1, true FROM orders WHERE o_orderkey % 4 = 1""")
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left and the tombstones."""
    stored = _stored(spark, sf_dir)
    gone = stored.where("o_orderkey % 4 = 1").select("o_orderkey", F.lit(9).cast("long").alias("_un"))
    kept, tombs = keyed.delete(stored, gone, ORDERS)
    return kept.withColumn("gone", F.lit(False)).unionByName(tombs.withColumn("gone", F.lit(True))).select("o_orderkey", "_un", "_vn", "gone")


@query("""
WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS op, arg_max(value, event_id) AS value, max(event_id) AS event_id, count(*) AS changes FROM events WHERE event_type <> 'view' GROUP BY user_id)
SELECT * FROM l WHERE op <> 'error'""")
def cdc_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of users: an error deletes, a view is aborted."""
    rows = events(spark, sf_dir, "user_id", F.col("event_type").alias("op"), "value", "event_id")
    return keyed.fold_changes(rows, ["user_id"], "event_id", deleted="error", aborted="view")


@query("""
WITH m AS (SELECT user_id % 4 AS _shard, max(event_id) AS h FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT event_id AS _un, user_id % 4 AS _shard FROM events LEFT JOIN m ON user_id % 4 = _shard WHERE h IS NULL OR event_id > h""")
def apply_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, F.col("event_id").alias("_un"), (F.col("user_id") % 4).alias("_shard"), "event_type")
    return keyed.apply_once(rows, rows.where("event_type = 'click'")).select("_un", "_shard")


@query("SELECT user_id % 4 AS _shard, max(event_id) AS max_un, arg_max(event_id * 2, event_id) AS max_sn FROM events GROUP BY 1")
def last_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.last_numbers(events(spark, sf_dir, (F.col("user_id") % 4).alias("_shard"), F.col("event_id").alias("_un"), (F.col("event_id") * 2).alias("_sn")))


# -- joins


TICKS = ((0.0, 1000.0, 0.01), (1000.01, 1500.0, 0.05), (1400.0, 1800.0, 0.1), (1800.01, None, 0.5))


@query("""
WITH t(min_price, max_price, tick_size) AS (VALUES (0.0::DOUBLE, 1000.0::DOUBLE, 0.01::DOUBLE), (1000.01, 1500.0, 0.05), (1400.0, 1800.0, 0.1), (1800.01, NULL, 0.5)),
p AS (SELECT p_partkey, p_retailprice FROM part)
SELECT p_partkey, p_retailprice, (SELECT arg_min(tick_size, min_price) FROM t WHERE p_retailprice >= min_price AND (max_price IS NULL OR p_retailprice <= max_price)) AS tick_size FROM p""")
def band_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = spark.createDataFrame([("all", *x) for x in TICKS], "tbl string, min_price double, max_price double, tick_size double")
    prices = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.lit("all").alias("tbl"))
    return market.bands(ticks, prices, "p_retailprice").drop("tbl")


@query("""
SELECT c_custkey, n_nationkey, n_name FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'N' || c_nationkey ELSE (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) END AS probe FROM customer)
JOIN nation ON probe = n_name OR probe = 'N' || n_nationkey""")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers find their nation by its name or by a second symbol."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.concat(F.lit("N"), "n_nationkey").alias("alt"))
    named = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    probes = named.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("alt")).otherwise(F.col("n_name")).alias("probe"))
    return market.by_any_name(probes, nations, "probe", ["n_name", "alt"]).select("c_custkey", "n_nationkey", "n_name")


@query("""
WITH i AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 <> 0 THEN p_partkey // 10 * 10 + CASE WHEN p_partkey % 50 = 11 THEN 1000000000 ELSE 0 END END AS underlying FROM part)
SELECT id, underlying, true AS tradeable FROM i WHERE underlying IS NOT NULL UNION ALL SELECT DISTINCT underlying, NULL, false FROM i WHERE underlying IS NOT NULL AND underlying NOT IN (SELECT id FROM i)""")
def derivative_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as futures on every tenth part; missing underlyings are made."""
    key = F.col("p_partkey")
    under = F.when(key % 10 != 0, F.expr("p_partkey div 10 * 10") + F.when(key % 50 == 11, 1_000_000_000).otherwise(0))
    instruments = table(spark, sf_dir, "part").select(key.alias("id"), F.col("p_name").alias("symbol"), under.alias("underlying"))
    own, missing = market.derivatives(instruments)
    return own.select("id", "underlying", F.lit(True).alias("tradeable")).unionByName(missing.select("id", F.lit(None).cast("long").alias("underlying"), "tradeable"))


@query("""
WITH k AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'V' || (l_suppkey % 3) || '/' || l_orderkey WHEN 1 THEN 'V' || (l_suppkey % 3) || '/' || l_partkey || '/' || l_orderkey
       ELSE 'V' || (l_suppkey % 3) || '/' || l_partkey || '/' || l_linestatus || '/' || l_orderkey END AS key FROM lineitem)
SELECT key, count(*) AS n FROM k GROUP BY key""")
def order_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.element_at(F.array(F.lit("venue"), F.lit("book"), F.lit("side")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(scope.alias("scope"), F.concat(F.lit("V"), (F.col("l_suppkey") % 3).cast("string")).alias("venue"), F.col("l_partkey").alias("book"), F.col("l_linestatus").alias("side"), F.col("l_orderkey").alias("order_id"))
    return rows.select(market.order_key().alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT l_orderkey AS combo, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) GROUP BY 1),
e AS (SELECT combo, unnest(ids) AS leg_id, unnest(range(len(ids))) AS leg FROM c)
SELECT combo, CAST(leg AS INTEGER) AS leg, leg_id, CASE leg % 2 WHEN 0 THEN 'B' ELSE 'S' END AS side, leg + 1 AS ratio, p_brand FROM e LEFT JOIN part ON leg_id = p_partkey""")
def combination_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    ids = rows.groupBy(F.col("l_orderkey").alias("combo")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("leg_ids"))
    places = F.sequence(F.lit(0), F.size("leg_ids") - 1)
    combos = ids.withColumns({"sides": F.transform(places, lambda i: F.when(i % 2 == 0, "B").otherwise("S")), "ratios": F.transform(places, lambda i: i.cast("long") + 1)})
    return market.legs(combos, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand"))


@query("""
WITH r AS (SELECT c_custkey, n_regionkey AS venue, n_nationkey AS segment, c_mktsegment AS id FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT * FROM r WHERE venue = 1 OR (venue = 2 AND segment = 8) OR (venue = 0 AND segment = 0 AND id = 'BUILDING') OR (venue = 1 AND segment = 2 AND id = 'BUILDING')""")
def hier_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("venue"), F.col("n_nationkey").alias("segment"), F.col("c_mktsegment").alias("id"))
    wanted = spark.createDataFrame([(1, None, None), (2, 8, None), (0, 0, "BUILDING"), (1, 2, "BUILDING")], "venue int, segment int, id string")
    return market.hierarchical(rows, wanted, ["venue", "segment", "id"])


@query("SELECT c_custkey, true AS buys FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, false FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    people, bought = table(spark, sf_dir, "customer").select("c_custkey"), orders(spark, sf_dir, F.col("o_custkey").alias("c_custkey"))
    return people.join(bought, "c_custkey", "left_semi").withColumn("buys", F.lit(True)).unionByName(people.join(bought, "c_custkey", "left_anti").withColumn("buys", F.lit(False)))


# -- telemetry, alerts, sinks, CSV


@query("WITH s AS (SELECT user_id, arg_max(event_type, event_id) AS name, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id) SELECT * FROM s WHERE starts_with(name, 'p')")
def telemetry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "user_id", F.col("event_type").alias("name"), "value", "event_id")
    return tables.named(tables.latest(rows, ["user_id"], "event_id"), "name", "p*")


@query("SELECT event_id, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS yyyymmdd, CAST(row_number() OVER (PARTITION BY strftime(ts, '%Y%m%d') ORDER BY ts, event_id) - 1 AS INTEGER) AS seq_no FROM events WHERE event_type = 'error'")
def daily_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.numbered_by_day(events(spark, sf_dir, "ts", "event_id", "event_type").where("event_type = 'error'").drop("event_type")).drop("ts")


@query("SELECT 'trades' AS sink, event_id, value FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'refdata', event_id, NULL FROM events WHERE event_type = 'signup'")
def sink_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "event_id", "event_type", "value")
    out = tables.fan_out(rows, {"trades": F.col("event_type") == "purchase", "refdata": F.col("event_type") == "signup"}, {"trades": ["event_id", "value"], "refdata": ["event_id"]})
    return out["trades"].withColumn("sink", F.lit("trades")).unionByName(out["refdata"].withColumn("sink", F.lit("refdata")), allowMissingColumns=True)


@query("SELECT p_partkey, p_name || ', \"' || p_brand || '\"' AS label, p_size, -1.5::DOUBLE AS missing FROM part")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as CSV with quotes and commas and read by the header's names."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_size", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("label"), "p_partkey")
    tables.write_csv(rows, path := shared_path(spark, "csv"), ["label", "p_size", "p_partkey", "p_brand"])
    schema = StructType([StructField("p_partkey", LongType()), StructField("label", StringType()), StructField("p_size", IntegerType()), StructField("missing", DoubleType())])
    return tables.read_csv(spark, path, schema, {"missing": -1.5})


# -- functions


@query("""
WITH d AS (SELECT l_suppkey, CAST(round(l_extendedprice * 100) AS HUGEINT) AS c FROM lineitem)
SELECT l_suppkey, CAST(sum(c) AS DOUBLE) / 100 AS total, CAST((sum(c) * 10000000000000000) // count(*) AS VARCHAR) AS mean_mantissa FROM d GROUP BY l_suppkey""")
def decimal_sum_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sums, and means cut to 18 places, as a double and a whole mantissa."""
    price = F.round("l_extendedprice", 2).cast(decimals.KIND)
    found = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(decimals.total(price).alias("t"), F.count(F.lit(1)).alias("n"))
    mean = decimals.divide(F.col("t"), F.col("n"))
    mantissa = F.regexp_replace(F.regexp_replace(mean.cast("string"), r"\.", ""), "^0+(?=.)", "")
    return found.select("l_suppkey", F.col("t").cast("double").alias("total"), mantissa.alias("mean_mantissa"))


@query("""
WITH d AS (SELECT DISTINCT CAST(round(l_extendedprice * 100) AS HUGEINT) AS p, CAST(l_quantity AS HUGEINT) AS q FROM lineitem)
SELECT CAST(p AS BIGINT) AS p, CAST(q AS BIGINT) AS q, CAST(p * q AS DOUBLE) / 100 AS product, CAST((p * 10000000000000000) // q AS VARCHAR) AS quotient_mantissa, CAST(p // 100 AS BIGINT) AS whole FROM d""")
def decimal_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs are made distinct as doubles, which are smaller to shuffle and compare than decimals."""
    pairs = table(spark, sf_dir, "lineitem").select(F.round("l_extendedprice", 2).alias("p"), F.rint("l_quantity").alias("q")).distinct()
    rows = pairs.select(F.col("p").cast(decimals.KIND).alias("p"), F.col("q").cast("long").alias("q"))
    digits = F.translate(decimals.divide_whole(F.col("p"), F.col("q")).cast("string"), ".", "")
    product = decimals.multiply(F.col("p"), F.col("q").cast(decimals.KIND)).cast("double")
    return rows.select((F.col("p") * 100).cast("long").alias("p"), "q", product.alias("product"), F.regexp_replace(digits, "^0+(?=.)", "").alias("quotient_mantissa"), decimals.floor(F.col("p")).cast("long").alias("whole"))


@query("""
SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS csv, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%Y%m%d-%H:%M:%S') AS fix, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS ymd,
       CAST(strftime(ts, '%H%M%S') AS INTEGER) AS hms, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(isoyear(ts) AS INTEGER) AS iso_year, CAST(week(ts) AS INTEGER) AS iso_week, strftime(ts, '%a') AS day_name,
       epoch_us(ts) * 1000 + event_id % 1000 AS back FROM events""")
def time_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats and parts of nanosecond times, and what parsing the CSV form gives back."""
    ns = F.col("ns")
    rows = events(spark, sf_dir, "event_id", (micros() * 1000 + F.col("event_id") % 1000).alias("ns"))
    plain = lambda c: F.regexp_replace(c, r"\.[0-9]+", "")
    return rows.select(
        "event_id", plain(times.format_csv(ns)).alias("csv"), F.regexp_replace(plain(times.format_iso(ns)), "Z$", "").alias("iso"), plain(times.format_fix(ns)).alias("fix"), times.ymd(ns).alias("ymd"),
        times.hms(ns).alias("hms"), times.parts(ns)["year"].alias("year"), times.parts(ns)["month"].alias("month"), times.weeks(ns)["iso_year"].alias("iso_year"), times.weeks(ns)["iso_week"].alias("iso_week"),
        times.names(ns)["day"].alias("day_name"), times.parse(times.format_csv(ns)).alias("back"),
    )


@query("""
SELECT event_id, epoch_us(ts) * 1000 + CAST(round(value * 100) AS BIGINT) * 10000000 AS later, CAST((epoch_us(ts) - 1700000000000000) AS DOUBLE) / 1000000 AS since FROM events""")
def time_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    ns = micros() * 1000
    rows = events(spark, sf_dir, "event_id", "ts", F.round("value", 2).cast(decimals.KIND).alias("v"))
    return rows.select("event_id", times.add(ns, F.col("v")).alias("later"), times.difference(ns, F.lit(1_700_000_000_000_000_000)).cast("double").alias("since"))


EVENT_TYPES = {"click": 0, "tap": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


@query("""
SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS code, event_type AS name,
       concat_ws('|', CASE WHEN event_id & 1 > 0 THEN 'odd' END, CASE WHEN event_id & 2 > 0 THEN 'two' END, CASE WHEN event_id & 8 > 0 THEN 'eight' END) AS flags, CAST(event_id & 11 AS INTEGER) AS bits FROM events""")
def enum_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {"odd": 0, "two": 1, "eight": 3}
    rows = events(spark, sf_dir, "event_id", "event_type")
    shown = rows.select("event_id", texts.enum_value(F.col("event_type"), EVENT_TYPES).alias("code"), texts.flag_names(F.col("event_id"), flags).alias("flags"))
    return shown.select("event_id", "code", texts.enum_name(F.col("code"), EVENT_TYPES).alias("name"), "flags", texts.flag_value(F.col("flags"), flags).alias("bits"))


@query("""
SELECT p_partkey, lower(substr(replace(p_brand, '#', '_'), 1, 1)) || substr(replace(replace(p_brand, '#', '_'), '_', ''), 2) AS camel, '"' || replace(p_name || '"x', '"', '""') || '"' AS quoted, lower(hex(encode(p_name))) AS hexed,
       to_base64(encode(p_name)) AS b64, regexp_replace(p_name, '([a-z])([a-z]*)', '<\\1>\\2') AS first_sub, length(p_name) AS width FROM part""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, brand = F.col("p_name"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))
    low = F.concat(F.lower(F.substring(brand, 1, 1)), F.substring(brand, 2, 1000))
    return table(spark, sf_dir, "part").select(
        "p_partkey", texts.camel(low).alias("camel"), texts.quote_csv(F.concat(name, F.lit('"x'))).alias("quoted"), F.lower(F.hex(F.encode(name, "UTF-8"))).alias("hexed"),
        F.base64(F.encode(name, "UTF-8")).alias("b64"), texts.replace_first(name, "([a-z])([a-z]*)", "<$1>$2").alias("first_sub"), texts.width(name).alias("width"),
    )


@query("""
WITH u AS (SELECT user_id, list_sort(list(DISTINCT CAST(event_id % 200 AS INTEGER))) AS a, list_sort(list(DISTINCT CAST(event_id % 90 AS INTEGER))) AS b FROM events GROUP BY user_id)
SELECT user_id, CAST(len(list_distinct(list_concat(a, b))) AS INTEGER) AS n_or, CAST(len(list_intersect(a, b)) AS INTEGER) AS n_and, CAST(len(list_distinct(list_concat(a, b))) - len(list_intersect(a, b)) AS INTEGER) AS n_xor,
       CAST(ceil((list_max(a) + 1) / 64.0) * 64 AS INTEGER) - len(a) AS n_flip, a[1] AS first, a[len(a)] AS last FROM u""")
def bitmap_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of numbers per user as bitmaps."""
    rows = events(spark, sf_dir, "user_id", "event_id").groupBy("user_id").agg(
        F.collect_set((F.col("event_id") % 200).cast("int")).alias("x"), F.collect_set((F.col("event_id") % 90).cast("int")).alias("y")
    ).select("user_id", bitmaps.of(F.col("x")).alias("a"), bitmaps.of(F.col("y")).alias("b"))
    a, b = F.col("a"), F.col("b")
    size = lambda m: F.size(m["bits"])
    return rows.select("user_id", size(bitmaps.union(a, b)).alias("n_or"), size(bitmaps.intersection(a, b)).alias("n_and"), size(bitmaps.difference(a, b)).alias("n_xor"), size(bitmaps.flip(a)).cast("long").alias("n_flip"), bitmaps.first(a).alias("first"), bitmaps.last(a).alias("last"))


# -- stores, reference data, sessions


@query("SELECT n_nationkey, n_name, n_regionkey, 'parquet' AS store FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'memory' FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey, 'memory' FROM nation")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written to stores of two kinds and read again, one of them in two batches."""
    spec, rows = TableSpec("nation", (KeySpec(("n_nationkey",)),)), table(spark, sf_dir, "nation")
    parquet, memory = tables.ParquetStore(spark, shared_path(spark, "store")), tables.MemoryStore()
    parquet.write(spec, rows)
    for batch in (rows, rows.withColumn("n_nationkey", F.col("n_nationkey") + 100)):
        memory.write(spec, batch)
    return parquet.read(spec).withColumn("store", F.lit("parquet")).unionByName(memory.read(spec).withColumn("store", F.lit("memory")))


@query("SELECT event_id, user_id, value FROM events WHERE ts >= (SELECT min(ts) + (max(ts) - min(ts)) / 4 FROM events) AND ts < (SELECT max(ts) FROM events)")
def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded events from a quarter of their time on, without the last moment."""
    span = table(spark, sf_dir, "events").agg(F.min("ts"), F.max("ts")).first()  # one row
    begin = span[0] + (span[1] - span[0]) / 4
    return tables.replay(spark, f"{sf_dir}/events.parquet", "ts", begin, span[1]).select("event_id", "user_id", "value")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def clustered_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a table of the catalog that is clustered by its key."""
    spec = TableSpec(f"orders_{uuid.uuid4().hex}", (KeySpec(("o_orderkey",)),))
    rows = orders(spark, sf_dir, "o_orderkey", "o_orderdate", "o_totalprice")
    tables.create(spark, spec, rows.schema)
    rows.write.format("parquet").bucketBy(64, "o_orderkey").sortBy("o_orderkey").mode("append").saveAsTable(spec.name)
    return spark.table(spec.name)


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as instruments: brands are symbols, sizes venues and segments, keys maturities, strikes, puts and calls."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("id"), F.col("p_brand").alias("symbol"), F.concat(F.lit("V"), (F.col("p_size") % 3).cast("string")).alias("venue"), F.concat(F.lit("S"), (F.col("p_size") % 2).cast("string")).alias("segment"),
        (key % 12).alias("mat"), F.when(key % 3 > 0, F.when(key % 3 == 1, "P").otherwise("C")).alias("put_call"), F.when(key % 3 > 0, key % 5).alias("strike"), F.col("p_size").alias("underlying"),
    )


_INSTRUMENTS = "i AS (SELECT p_partkey AS id, p_brand AS symbol, 'V' || (p_size % 3) AS venue, 'S' || (p_size % 2) AS segment, p_partkey % 12 AS mat, CASE p_partkey % 3 WHEN 1 THEN 'P' WHEN 2 THEN 'C' END AS put_call, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 5 END AS strike, p_size AS underlying FROM part)"


@query(f"WITH {_INSTRUMENTS} SELECT * FROM i WHERE symbol IN ('Brand#1', 'Brand#2', 'Brand#12', 'Brand#23') AND venue = 'V1' AND segment = 'S1' AND put_call = 'C'")
def instrument_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.lookup(instruments(spark, sf_dir), ["Brand#1", "Brand#2", "Brand#12", "Brand#23"], venue="V1", segment="S1", put_call="C")


@query(f"""
WITH {_INSTRUMENTS}, p AS (SELECT DISTINCT l_suppkey % 50 AS underlying, l_partkey % 12 AS mat, CASE l_partkey % 3 WHEN 1 THEN 'P' WHEN 2 THEN 'C' END AS put_call, CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 5 END AS strike FROM lineitem)
SELECT p.*, i.id, i.symbol FROM p LEFT JOIN i ON p.underlying = i.underlying AND p.mat = i.mat AND p.put_call IS NOT DISTINCT FROM i.put_call AND p.strike IS NOT DISTINCT FROM i.strike""")
def derivative_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Futures by underlying and maturity, options by put or call and strike too."""
    key = F.col("l_partkey")
    probes = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("underlying"), (key % 12).alias("mat"), F.when(key % 3 > 0, F.when(key % 3 == 1, "P").otherwise("C")).alias("put_call"), F.when(key % 3 > 0, key % 5).alias("strike")).distinct()
    return market.find_derivatives(probes, instruments(spark, sf_dir).select("id", "symbol", "underlying", "mat", "put_call", "strike"))


_STATE = "s AS (SELECT l_partkey AS id, max(l_extendedprice) AS high, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)"


@query(f"WITH {_INSTRUMENTS}, {_STATE} SELECT id, symbol, high, n, true AS required FROM i JOIN s USING (id) WHERE venue = 'V2' UNION ALL SELECT id, symbol, high, n, false FROM i LEFT JOIN s USING (id) WHERE venue = 'V2'")
def book_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The books of a venue's instruments, required and not."""
    state = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_extendedprice").alias("high"), F.count(F.lit(1)).alias("n"))
    asked = market.lookup(instruments(spark, sf_dir), venue="V2")
    one = lambda required: market.quotes(state, asked, ["id"], required).withColumn("required", F.lit(required))
    return one(True).unionByName(one(False))


@query("SELECT user_id % 5 AS venue, user_id % 3 AS segment, arg_max(event_type, event_id) AS session, max(event_id) AS since FROM events GROUP BY ALL")
def session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, (F.col("user_id") % 5).alias("venue"), (F.col("user_id") % 3).alias("segment"), F.col("event_type").alias("session"), F.col("event_id").alias("seq"))
    return market.sessions(rows)


@query("SELECT o_orderkey AS order_id, o_custkey, o_orderstatus = 'F' AS closed FROM orders")
def closed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that have ended move to the closed table."""
    rows = orders(spark, sf_dir, F.col("o_orderkey").alias("order_id"), "o_custkey")
    states = orders(spark, sf_dir, F.col("o_orderkey").alias("order_id"), F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 2 == 0, orders_.CLOSED).otherwise(orders_.REJECTED)).otherwise(orders_.ACKED).alias("new"))
    left, gone = orders_.close(rows, states)
    return left.withColumn("closed", F.lit(False)).unionByName(gone.withColumn("closed", F.lit(True)))


@query("""
WITH r AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS px, CASE WHEN p_size % 4 < 3 THEN p_size % 4 + 1 END AS to_ndp FROM part)
SELECT p_partkey, CASE WHEN to_ndp IS NULL OR to_ndp = 2 THEN px WHEN to_ndp = 1 THEN px // 10 ELSE px * 10 END AS px, coalesce(to_ndp, 2)::INTEGER AS ndp FROM r""")
def rescaled_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of two places whose instruments change to one or three."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("bigint").alias("px"), F.lit(2).alias("ndp"), F.when(F.col("p_size") % 4 < 3, F.col("p_size") % 4 + 1).cast("int").alias("to_ndp"))
    return market.rescaled(rows, ["px"], "ndp", "to_ndp")


@query("""
WITH p AS (SELECT l_partkey % 20 AS asset, l_suppkey % 4 AS venue, CAST(coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) AS BIGINT) AS long_qty, CAST(coalesce(sum(l_quantity) FILTER (l_linestatus <> 'O'), 0) AS BIGINT) AS short_qty FROM lineitem GROUP BY ALL)
SELECT *, long_qty - short_qty AS net_qty, long_qty + short_qty AS gross_qty FROM p""")
def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 20).alias("asset"), (F.col("l_suppkey") % 4).alias("venue"), F.when(F.col("l_linestatus") == "O", "B").otherwise("S").alias("side"), F.col("l_quantity").cast("bigint").alias("qty"))
    return market.exposure(rows, ["asset", "venue"])


@query("""
WITH d AS (SELECT event_id, -79366 + (CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) * event_id * 37 AS days FROM events),
c AS (SELECT *, days + 2440588 + 32082 AS c FROM d), y AS (SELECT *, (4 * c + 3) // 1461 AS y FROM c), e AS (SELECT *, c - 1461 * y // 4 AS e FROM y), m AS (SELECT *, (5 * e + 2) // 153 AS m FROM e)
SELECT event_id, CAST(CASE WHEN days < -79366 THEN y - 4800 + m // 10 ELSE year(DATE '1970-01-01' + days::INTEGER) END AS INTEGER) AS year, CAST(CASE WHEN days < -79366 THEN m + 3 - 12 * (m // 10) ELSE month(DATE '1970-01-01' + days::INTEGER) END AS INTEGER) AS month,
       CAST(CASE WHEN days < -79366 THEN e - (153 * m + 2) // 5 + 1 ELSE day(DATE '1970-01-01' + days::INTEGER) END AS INTEGER) AS day FROM m""")
def old_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on both sides of the calendar's reformation."""
    n = F.col("event_id")
    days = F.lit(times.REFORMATION) + F.when(n % 2 == 0, 1).otherwise(-1) * n * 37
    return events(spark, sf_dir, "event_id").select("event_id", times.calendar(days).alias("d")).select("event_id", "d.*")
