"""Series, rolling statistics and sequences over ``events`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import rolling, sequence, series
from millrace.plans.registry import query
from millrace.sources.tables import table

#: Numbers of events in a block of the long series.
WIDTH = 1 << 16


def cents(value: str = "value"):
    return F.round(F.col(value) * 100).cast("bigint")


def micros(at: str = "ts"):
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(at))


def seconds(at: str = "ts"):
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(at))


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``events`` with its value in whole cents; only the columns asked for are read."""
    found = table(spark, sf_dir, "events").withColumn("cents", cents())
    return found.select(*columns) if columns else found


@query("""
WITH m AS (
    SELECT event_id, user_id, count(c) OVER w AS n, sum(c) OVER w AS s, sum(c * c) OVER w AS q, min(c) OVER w AS low, max(c) OVER w AS high
    FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)
)
SELECT event_id, user_id, n, s::DOUBLE AS total, s::DOUBLE / n AS mean, (n * q - s * s)::DOUBLE / (n * n) AS var, sqrt((n * q - s * s)::DOUBLE / (n * n)) AS std, low::DOUBLE AS low, high::DOUBLE AS high
FROM m""")
def rolling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing statistics of each user's last ten values, in cents."""
    rows = events(spark, sf_dir, "event_id", "user_id", "ts", "cents")
    return rolling.rolling_stats(rows, "cents", ["ts", "event_id"], 10, ["user_id"]).drop("ts", "cents")


@query("""
WITH h AS (SELECT event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) AS v FROM events)
SELECT event_id, v[CAST(floor(len(v) * 0.5) AS INTEGER) + 1] AS median, v[CAST(floor(len(v) * 0.95) AS INTEGER) + 1] AS p95 FROM h""")
def rolling_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "event_id", "user_id", "ts", "value")
    return rolling.rolling_ranks(rows, "value", ["ts", "event_id"], 10, {"median": 0.5, "p95": 0.95}, ["user_id"]).select("event_id", "median", "p95")


@query("""
SELECT l_partkey, count(l_quantity) AS n, sum(l_quantity) AS total, round(avg(l_quantity), 4) AS mean, round(var_pop(l_quantity), 4) AS var,
       round(stddev_pop(l_quantity), 4) AS std, min(l_quantity) AS low, max(l_quantity) AS high
FROM lineitem GROUP BY l_partkey""")
def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.stats(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_partkey"], digits=4)


@query("""
WITH h AS (SELECT l_suppkey, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, v[CAST(floor(len(v) * 0.5) AS INTEGER) + 1] AS median, v[CAST(floor(len(v) * 0.95) AS INTEGER) + 1] AS p95 FROM h""")
def group_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.ranks(table(spark, sf_dir, "lineitem"), "l_extendedprice", {"median": 0.5, "p95": 0.95}, ["l_suppkey"])


@query("SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY l_quantity")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.histogram(table(spark, sf_dir, "lineitem"), "l_quantity")


@query("SELECT l_partkey, count(*) FILTER (l_quantity < 25) AS below FROM lineitem GROUP BY l_partkey")
def count_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.count_below(table(spark, sf_dir, "lineitem"), "l_quantity", F.lit(25.0), ["l_partkey"])


@query("""
WITH d AS (SELECT o_orderpriority, epoch_us(o_orderdate) AS b, epoch_us(l_shipdate) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT o_orderpriority, count(*) AS n, min(e - b) AS shortest, max(e - b) AS longest, CAST(sum(e - b) AS BIGINT) AS total, round(sum(e - b) / count(*), 2) AS mean FROM d GROUP BY 1""")
def interval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total is the SQL's BIGINT, so null where it exceeds that, which the SQL fails at; the mean is of the exact total."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", micros("o_orderdate").alias("b"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", micros("l_shipdate").alias("e"))
    found = rolling.intervals(orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")), "b", "e", ["o_orderpriority"])
    return found.withColumns({"total": F.col("total").try_cast("long"), "mean": F.round("mean", 2)})


@query("""
WITH b AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS bucket, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS bucket_total FROM events GROUP BY ALL)
SELECT *, CAST(sum(bucket_total) OVER w AS BIGINT) AS window_total, CAST(sum(bucket_total) OVER w AS BIGINT) / 10800.0::DOUBLE AS window_mean
FROM b WINDOW w AS (PARTITION BY event_type ORDER BY bucket RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def bucket_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "event_type", seconds().alias("at"), "cents")
    return rolling.value_window(rows, "at", "cents", 3, 3600, ["event_type"])


@query("""
WITH r AS (SELECT user_id, event_id % 64 AS slot, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL),
h AS (SELECT user_id, max(event_id % 64) AS highest FROM events GROUP BY user_id)
SELECT user_id, slot, value, event_id FROM r JOIN h USING (user_id) WHERE slot > highest - 16""")
def last_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "user_id", (F.col("event_id") % 64).alias("slot"), "value", "event_id")
    return rolling.last_slots(rows, "slot", 16, "event_id", ["user_id"])


_CENTS = "SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events"


@query(f"SELECT event_id, cents - coalesce(lag(cents) OVER (ORDER BY event_id), 0) AS delta FROM ({_CENTS})")
def delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.delta(events(spark, sf_dir, "event_id", "cents"), "event_id", "cents", "delta", width=WIDTH).select("event_id", "delta")


@query(f"""
WITH d AS (SELECT event_id, cents - coalesce(lag(cents) OVER (ORDER BY event_id), 0) AS d FROM ({_CENTS}))
SELECT event_id, d - coalesce(lag(d) OVER (ORDER BY event_id), 0) AS delta2 FROM d""")
def delta2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.delta2(events(spark, sf_dir, "event_id", "cents"), "event_id", "cents", "delta2", width=WIDTH).select("event_id", "delta2")


@query(f"SELECT event_id, CAST(sum(cents) OVER (ORDER BY event_id) AS BIGINT) AS total FROM ({_CENTS})")
def integrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.running_sum(events(spark, sf_dir, "event_id", "cents"), "event_id", "cents", "total", width=WIDTH).select("event_id", "total")


@query("""
WITH m AS (SELECT event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (ORDER BY event_id)),
r AS (SELECT *, CAST(sum(f) OVER (ORDER BY event_id) AS BIGINT) AS run FROM m)
SELECT run, min(event_id) AS first_at, max(event_id) AS last_at, count(*) AS length, any_value(event_type) AS event_type FROM r GROUP BY run""")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.run_lengths(events(spark, sf_dir, "event_id", "event_type"), "event_id", "event_type", width=WIDTH)


@query("SELECT event_id, value, o AS \"offset\" FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS o FROM events) WHERE o >= 100")
def seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.seek(series.offsets(events(spark, sf_dir, "event_id", "value"), "event_id", width=WIDTH), 100)


@query("""
WITH o AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS o FROM events)
SELECT x.value AS value, (SELECT min(o) FROM o WHERE event_id >= x.value AND o >= x.lo AND o <= x.hi) AS "offset"
FROM (VALUES (20, 0, 1000000000), (150, 200, 1000000000), (300, 0, 310), (300, 0, 10)) AS x(value, lo, hi)""")
def lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = series.offsets(events(spark, sf_dir, "event_id"), "event_id", width=WIDTH)
    found = None
    for value, low, high in ((20, None, None), (150, 200, None), (300, None, 310), (300, None, 10)):
        part = series.lower_bound(numbered, "event_id", value, low, high).withColumn("value", F.lit(value))
        found = part if found is None else found.unionByName(part)
    return found


def _asof_sql(op: str) -> str:
    return f"""
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT p.event_id, p.user_id, s.event_id AS right_event_id FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts {op} s.ts"""


def _asof(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    rows = events(spark, sf_dir, "event_id", "user_id", "ts", "event_type")
    clicks, bought = (rows.where(F.col("event_type") == t).drop("event_type") for t in ("click", "purchase"))
    return series.asof(clicks, bought, "ts", "ts", ["user_id"], width=86_400 * 30, unit=seconds("_at"), **how).select("event_id", "user_id", "right_event_id")


@query(_asof_sql("<="))
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the user's next purchase."""
    return _asof(spark, sf_dir)


@query(_asof_sql(">="))
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, direction="backward")


@query(_asof_sql("<"))
def asof_forward_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, strict=True)


@query("""
WITH n AS (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nx FROM events)
SELECT user_id, event_id + 1 AS gap_key, nx - event_id - 1 AS gap_length FROM n WHERE nx - event_id > 1""")
def seq_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is missing between each user's numbers."""
    return series.gaps(events(spark, sf_dir, "event_id", "user_id"), "event_id", ["user_id"], width=WIDTH)


@query("""
WITH n AS (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nx FROM events),
g AS (SELECT user_id, event_id + 1 AS gap_key, nx - event_id - 1 AS gap_length FROM n WHERE nx - event_id > 1)
SELECT user_id, min(gap_key) AS gap_key, arg_min(gap_length, gap_key) AS gap_length FROM g GROUP BY user_id""")
def first_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.first_gap(events(spark, sf_dir, "event_id", "user_id"), "event_id", ["user_id"])


_BLOCKS = """
WITH m AS (SELECT event_id, CAST(floor(event_id / 300) AS BIGINT) % 3 AS ndp, row_number() OVER (ORDER BY event_id) - 1 AS o FROM events),
n AS (SELECT *, CASE WHEN lag(ndp) OVER (ORDER BY event_id) <> ndp THEN 1 ELSE 0 END AS f FROM m),
p AS (SELECT *, sum(f) OVER (ORDER BY event_id) AS part FROM n),
q AS (SELECT *, floor((row_number() OVER (PARTITION BY part ORDER BY event_id) - 1) / 128) AS sub FROM p),
b AS (SELECT event_id, ndp, o AS "offset", dense_rank() OVER (ORDER BY part, sub) - 1 AS blk FROM q)"""


@query(_BLOCKS + " SELECT * FROM b")
def scale_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored blocks that a change of scale or 128 rows end."""
    return _blocks(spark, sf_dir)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "event_id", (F.floor(F.col("event_id") / 300) % 3).alias("ndp"))
    return series.offsets(series.scale_blocks(rows, "event_id", "ndp", capacity=128, width=WIDTH), "event_id", width=WIDTH)


@query(_BLOCKS + ', e AS (SELECT *, max("offset") OVER (PARTITION BY blk) AS m FROM b) SELECT event_id, ndp, "offset", blk FROM e WHERE m >= 500')
def purge_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.purge(_blocks(spark, sf_dir), 500)[0].select("event_id", "ndp", "offset", "blk")


@query("""
WITH r AS (SELECT user_id, event_id % 64 AS slot, arg_max(event_id & 3, event_id) AS field FROM events GROUP BY ALL),
h AS (SELECT user_id, max(event_id % 64) AS highest FROM events GROUP BY user_id),
f AS (SELECT user_id, slot, field FROM r JOIN h USING (user_id) WHERE slot > highest - 2)
SELECT user_id, slot, field, count(*) OVER w = 2 AND min(field) OVER w = 3 AS all_set FROM f WINDOW w AS (PARTITION BY user_id)""")
def bit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of two bits in the two highest slots of each user."""
    rows = events(spark, sf_dir, "user_id", (F.col("event_id") % 64).alias("slot"), F.col("event_id").alias("field"), "event_id")
    return rolling.bit_window(rows, "slot", "field", 2, 2, "event_id", ["user_id"])


# -- sequences


@query("WITH b AS (SELECT user_id, min(event_id) AS b FROM events WHERE event_type = 'signup' GROUP BY user_id) SELECT e.user_id, event_id, value FROM events e JOIN b ON e.user_id = b.user_id WHERE event_id >= b")
def after_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events from the first signup on."""
    rows = events(spark, sf_dir, "user_id", "event_id", "value", "event_type")
    return sequence.after_barrier(rows, "event_id", F.col("event_type") == "signup", ["user_id"]).drop("event_type")


@query("SELECT event_id, any_value(value) AS value FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 3 = 0) WHERE event_id >= 10 GROUP BY event_id")
def dedup_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "event_id", "value")
    return sequence.reorder(rows.unionByName(rows.where("event_id % 3 = 0")), "event_id", head=10)


@query("""
WITH r AS (SELECT user_id, event_id AS b, 1 + event_id % 400 AS n FROM events),
c AS (SELECT *, max(b + n) OVER (PARTITION BY user_id ORDER BY b, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM r)
SELECT user_id, greatest(b, coalesce(covered, b), 50) AS b, b + n - greatest(b, coalesce(covered, b), 50) AS n FROM c WHERE b + n > greatest(b, coalesce(covered, b), 50)""")
def clip_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "user_id", F.col("event_id").alias("b"), (1 + F.col("event_id") % 400).alias("n"))
    return sequence.clip_overlaps(rows, "b", "n", ["user_id"], head=50)


@query("""
SELECT *, row_number() OVER (ORDER BY ts, source_rank) AS place FROM (
    SELECT event_id, ts, CAST(0 AS INTEGER) AS source_rank FROM events WHERE event_type = 'click'
    UNION ALL SELECT event_id, ts, 1 FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, ts, 2 FROM events WHERE event_type = 'click')""")
def kway_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three captures merged by their stamps; the places are numbered from the blocks of the merged order."""
    rows = events(spark, sf_dir, "event_id", "ts", "event_type")
    merged = sequence.merge([rows.where(F.col("event_type") == t).drop("event_type") for t in ("click", "view", "click")], ["ts"])
    keyed = merged.withColumn("_key", micros() * 4 + F.col("source_rank"))
    return series.offsets(keyed, "_key", width=86_400_000_000 * 4).withColumn("place", F.col("offset") + 1).drop("_key", "offset")


@query("""
WITH m AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events),
s AS (SELECT user_id, event_id, value FROM events, m WHERE epoch_us(ts) < a + (b - a) // 2),
t AS (SELECT user_id, max(event_id) AS taken FROM s GROUP BY user_id)
SELECT * FROM s UNION ALL SELECT e.user_id, e.event_id, e.value FROM events e LEFT JOIN t ON e.user_id = t.user_id WHERE taken IS NULL OR e.event_id > taken""")
def hand_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of the first half of the time, and all events as increments."""
    rows = events(spark, sf_dir, "user_id", "event_id", "value", "ts")
    ends = rows.agg(F.min(micros()).alias("a"), F.max(micros()).alias("b"))
    first = rows.crossJoin(F.broadcast(ends)).where(micros() < F.col("a") + F.expr("(b - a) div 2"))  # one row
    return sequence.hand_over(first.select("user_id", "event_id", "value", F.col("event_id").alias("taken_at")), rows.drop("ts"), "event_id", "taken_at", ["user_id"])


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN epoch_ns(ts) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) + event_id % 1000 AS event_ns FROM events""")
def event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    beat = F.when(F.col("event_type") == "signup", micros() * 1000).alias("beat")
    rows = events(spark, sf_dir, "event_id", "user_id", beat, (F.col("event_id") % 1000).alias("nsec"))
    return sequence.event_time(rows, "event_id", "beat", "nsec", ["user_id"]).select("event_id", "event_ns")


@query("""
WITH s AS (SELECT user_id, CAST(floor(min(epoch(ts)) / 86400) AS BIGINT) + 1 AS f, CAST(floor(max(epoch(ts)) / 86400) AS BIGINT) AS t FROM events GROUP BY user_id)
SELECT user_id, unnest(range(f, t + 1)) * 86400 AS fires_at FROM s WHERE f <= t""")
def timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.timers(events(spark, sf_dir, "user_id", seconds().alias("at")), "at", 86_400, ["user_id"])


@query("""
WITH r AS (SELECT event_id, event_id * 3 AS sent FROM events WHERE event_id * 3 >= 30)
SELECT event_id, sent, (sent - (SELECT min(sent) FROM r)) / 2.0::DOUBLE + (row_number() OVER (ORDER BY sent) - 1) * 5 AS due FROM r""")
def paced_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.paced(events(spark, sf_dir, "event_id", (F.col("event_id") * 3).alias("sent")), "sent", 2.0, 5, begin=30, width=WIDTH * 3)
