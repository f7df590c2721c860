"""Books, trades and orders over the test tables, and streaming jobs run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import market, orders
from millrace.plans.registry import query, shared_path
from millrace.plans.series_queries import events, micros
from millrace.sources.tables import table
from millrace.streaming import jobs


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as resting orders: suppliers are books, open lines are bids, prices are whole hundreds."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("book"), F.when(F.col("l_linestatus") == "O", "B").otherwise("S").alias("side"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity") / 100).cast("long").alias("price"), F.col("l_quantity").cast("long").alias("qty"),
    )


_BOOK = "o AS (SELECT l_suppkey AS book, CASE l_linestatus WHEN 'O' THEN 'B' ELSE 'S' END AS side, CAST(floor(l_extendedprice / l_quantity / 100) AS BIGINT) AS price, CAST(l_quantity AS BIGINT) AS qty FROM lineitem), lv AS (SELECT book, side, price, CAST(sum(qty) AS BIGINT) AS qty, count(*) AS n_orders FROM o GROUP BY ALL)"


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.levels(book(spark, sf_dir))


@query(f"WITH {_BOOK} SELECT * FROM lv")
def book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(spark, sf_dir)


@query(f"WITH {_BOOK} SELECT book, max(price) FILTER (side = 'B') AS bid, arg_max(qty, price) FILTER (side = 'B') AS bid_qty, min(price) FILTER (side = 'S') AS ask, arg_min(qty, price) FILTER (side = 'S') AS ask_qty FROM lv GROUP BY book")
def l2_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.l2(levels(spark, sf_dir))


@query(f"WITH {_BOOK} SELECT * FROM lv WHERE CASE side WHEN 'B' THEN price > 12 AND price <= 15 ELSE price >= 12 AND price < 15 END")
def price_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.in_range(levels(spark, sf_dir), 12, 15)


@query(f"WITH {_BOOK} SELECT book, side, CAST(sum(price * qty) AS BIGINT) AS nv, CAST(sum(qty) AS BIGINT) AS total_qty, sum(price * qty)::DOUBLE / sum(qty)::DOUBLE AS vwap FROM lv GROUP BY ALL")
def side_vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.side_totals(levels(spark, sf_dir), ["book", "side"])


_CUM = "c AS (SELECT *, sum(qty) OVER (PARTITION BY book, side ORDER BY CASE side WHEN 'B' THEN -price ELSE price END) AS cum, CASE side WHEN 'B' THEN -price ELSE price END AS better FROM lv)"


@query(f"WITH {_BOOK}, {_CUM} SELECT book, side, coalesce(arg_min(price, better) FILTER (cum >= 2000), arg_max(price, better)) AS match_px FROM c GROUP BY ALL")
def match_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.match_px(levels(spark, sf_dir), 2000)


@query(f"WITH {_BOOK} SELECT book, side, CAST(coalesce(sum(qty) FILTER (CASE side WHEN 'B' THEN price >= 13 ELSE price <= 13 END), 0) AS BIGINT) AS match_qty FROM lv GROUP BY ALL")
def match_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.match_qty(levels(spark, sf_dir), 13)


@query(f"WITH {_BOOK} SELECT book % 7 AS out_book, side, price, CAST(sum(qty) AS BIGINT) AS qty, count(*) AS n_inputs, min(book // 7) AS best_rank FROM lv GROUP BY ALL")
def consolidated_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("book")).distinct().select("book", (F.col("book") % 7).alias("out_book"), F.expr("book div 7").alias("rank"))
    return market.consolidated(levels(spark, sf_dir), mapping)


def resting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order of ``orders`` rests in the book of its customer's remainder by 50."""
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("book"), F.when(F.col("o_orderstatus") == "O", "B").otherwise("S").alias("side"), F.col("o_orderkey").alias("order_id"),
        F.floor(F.col("o_totalprice") / 1000).cast("long").alias("price"), (F.col("o_orderkey") % 90 + 10).alias("qty"), F.lit(None).cast("long").alias("rank"), F.col("o_orderkey").alias("since"),
    )


_RESTING = "o AS (SELECT o_custkey % 50 AS book, CASE o_orderstatus WHEN 'O' THEN 'B' ELSE 'S' END AS side, o_orderkey AS order_id, CAST(floor(o_totalprice / 1000) AS BIGINT) AS price, o_orderkey % 90 + 10 AS qty FROM orders)"


@query(f"WITH {_RESTING} SELECT book, side, order_id, price, CAST(row_number() OVER (PARTITION BY book, side, price ORDER BY order_id) AS INTEGER) AS place FROM o")
def queue_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.ranked(resting(spark, sf_dir)).select("book", "side", "order_id", "price", "place")


@query(f"""
WITH {_RESTING}, c AS (SELECT *, sum(qty) OVER (PARTITION BY book ORDER BY price, order_id) AS cum FROM o WHERE side = 'S' AND (book % 2 = 1 OR price <= 200))
SELECT book, side, order_id, price, CAST(greatest(0, least(qty, 300 - (cum - qty))) AS BIGINT) AS fill, CAST(qty - greatest(0, least(qty, 300 - (cum - qty))) AS BIGINT) AS rest FROM c WHERE 300 - (cum - qty) > 0""")
def match_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A buyer of 300 in every book: at 200 at most in even ones, at any price in odd ones."""
    buyers = spark.range(50).select(F.col("id").alias("book"), F.lit("B").alias("side"), F.lit(300).cast("long").alias("qty"), F.when(F.col("id") % 2 == 0, F.lit(200)).cast("long").alias("price"))
    return market.match(resting(spark, sf_dir), buyers)[0]


# -- folds of events


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, "event_id", F.col("user_id").alias("book"), F.floor(F.col("cents") / 2000).alias("price"))


_TICKS = "t AS (SELECT event_id, user_id AS book, CAST(floor(CAST(round(value * 100) AS BIGINT) / 2000) AS BIGINT) AS price FROM events)"


@query(f"""
WITH {_TICKS}, s AS (SELECT *, sign(price - lag(price) OVER (PARTITION BY book ORDER BY event_id)) AS sg FROM t),
l AS (SELECT *, last_value(CASE WHEN sg <> 0 THEN sg END IGNORE NULLS) OVER (PARTITION BY book ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS lst FROM s)
SELECT event_id, book, price, CASE WHEN sg > 0 THEN 'Up' WHEN sg < 0 THEN 'Down' WHEN lst > 0 THEN 'LevelUp' WHEN lst < 0 THEN 'LevelDown' END AS tick FROM l""")
def tick_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.tick_direction(ticks(spark, sf_dir), ["book"], "event_id", "price")


@query(f"WITH {_TICKS} SELECT *, max(price) OVER w AS high, min(price) OVER w AS low FROM t WINDOW w AS (PARTITION BY book ORDER BY event_id)")
def running_hilo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.high_low(ticks(spark, sf_dir), ["book"], "event_id", "price")


@query(f"WITH {_TICKS} SELECT event_id, CAST(sum(price * (1 + event_id % 9)) OVER w AS BIGINT) AS acc_vol, CAST(sum(1 + event_id % 9) OVER w AS BIGINT) AS acc_vol_qty, (sum(price * (1 + event_id % 9)) OVER w)::DOUBLE / (sum(1 + event_id % 9) OVER w)::DOUBLE AS vwap FROM t WINDOW w AS (PARTITION BY book ORDER BY event_id)")
def trade_vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).withColumn("qty", 1 + F.col("event_id") % 9)
    return market.accumulate(rows, ["book"], "event_id", "price", "qty").select("event_id", "acc_vol", "acc_vol_qty", "vwap")


@query("""
WITH m AS (SELECT event_id, user_id, CASE WHEN event_type = 'click' THEN value END AS bid, CASE WHEN event_type = 'view' THEN value END AS ask, event_type = 'error' AS clr FROM events),
g AS (SELECT *, sum(CASE WHEN clr THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS part FROM m)
SELECT event_id, user_id, last_value(bid IGNORE NULLS) OVER (PARTITION BY user_id, part ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS bid, last_value(ask IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS ask FROM g""")
def l1_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks set the bid, views the ask, errors clear the bid."""
    kind = F.col("event_type")
    rows = events(spark, sf_dir, "event_id", "user_id", F.when(kind == "click", F.col("value")).alias("bid"), F.when(kind == "view", F.col("value")).alias("ask"), F.when(kind == "error", F.array(F.lit("bid"))).alias("cleared"))
    return market.l1(rows, ["user_id"], "event_id", ["bid", "ask"], "cleared").drop("cleared")


@query("""
WITH u AS (SELECT event_id AS seq, user_id AS book, CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'S' END AS side, event_id % 11 AS price, CASE WHEN event_type = 'error' THEN 0 WHEN event_type IN ('click', 'signup') THEN -(event_id % 5) ELSE event_id % 40 END AS qty, event_type NOT IN ('error', 'view') AS delta FROM events),
p AS (SELECT *, sum(CASE WHEN delta THEN 0 ELSE 1 END) OVER (PARTITION BY book, side, price ORDER BY seq) AS part FROM u),
s AS (SELECT book, side, price, part, CAST(sum(qty) AS BIGINT) AS qty, max(seq) AS last_seq FROM p GROUP BY ALL)
SELECT book, side, price, arg_max(qty, part) AS qty, arg_max(last_seq, part) AS last_seq FROM s GROUP BY ALL HAVING arg_max(qty, part) > 0""")
def fold_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and views set levels, the rest are deltas."""
    return market.fold_levels(level_updates(spark, sf_dir))


def level_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, n = F.col("event_type"), F.col("event_id")
    qty = F.when(kind == "error", 0).when(kind.isin("click", "signup"), -(n % 5)).otherwise(n % 40)
    return events(spark, sf_dir, n.alias("seq"), F.col("user_id").alias("book"), F.when(n % 2 == 0, "B").otherwise("S").alias("side"), (n % 11).alias("price"), qty.cast("long").alias("qty"), (~kind.isin("error", "view")).alias("delta"))


@query("""
SELECT book, trade_id, op, value, seq FROM (SELECT user_id AS book, event_id % 20 AS trade_id, CASE event_type WHEN 'error' THEN 'cancel' WHEN 'view' THEN 'correct' ELSE 'add' END AS op, value, event_id AS seq,
       row_number() OVER (PARTITION BY user_id, event_id % 20 ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND op <> 'cancel'""")
def trade_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = events(spark, sf_dir, F.col("user_id").alias("book"), (F.col("event_id") % 20).alias("trade_id"), F.when(kind == "error", "cancel").when(kind == "view", "correct").otherwise("add").alias("op"), "value", F.col("event_id").alias("seq"))
    return market.trades(rows)


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as order messages: clicks add, views modify, purchases reduce, errors cancel, some signups reset."""
    kind, n = F.col("event_type"), F.col("event_id")
    op = F.when(kind == "click", "add").when(kind == "view", "modify").when(kind == "purchase", "reduce").when(kind == "signup", F.when(n % 5 == 0, "reset").otherwise("add")).otherwise("cancel")
    return events(
        spark, sf_dir, F.col("user_id").alias("book"), op.alias("op"), F.when(n % 2 == 0, "B").otherwise("S").alias("side"), (n % 6).alias("order_id"),
        F.when(n % 4 != 0, n % 13).alias("price"), F.when(~((kind == "view") & (n % 3 == 0)), n % 30 + 1).alias("qty"), F.lit(None).cast("int").alias("rank"), n.alias("seq"),
    )


@query("""
WITH RECURSIVE e AS (
    SELECT user_id AS book, CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'modify' WHEN 'purchase' THEN 'reduce' WHEN 'signup' THEN CASE WHEN event_id % 5 = 0 THEN 'reset' ELSE 'add' END ELSE 'cancel' END AS op,
           CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'S' END AS side, event_id % 6 AS order_id, CASE WHEN event_id % 4 <> 0 THEN event_id % 13 END AS price,
           CASE WHEN NOT (event_type = 'view' AND event_id % 3 = 0) THEN event_id % 30 + 1 END AS qty, event_id AS seq FROM events),
r AS (SELECT book, max(seq) AS reset FROM e WHERE op = 'reset' GROUP BY book),
s AS (SELECT e.*, row_number() OVER (PARTITION BY e.book, side, order_id ORDER BY seq) AS n FROM e LEFT JOIN r ON e.book = r.book WHERE op <> 'reset' AND (reset IS NULL OR seq > reset)),
f AS (
    SELECT DISTINCT book, side, order_id, 0::BIGINT AS n, NULL::BIGINT AS qty, NULL::BIGINT AS price, NULL::BIGINT AS since FROM s
    UNION ALL
    SELECT book, side, order_id, n, CASE WHEN q > 0 THEN q END, CASE WHEN q > 0 THEN p END, CASE WHEN q > 0 THEN t END FROM (
        SELECT s.book, s.side, s.order_id, s.n, CASE s.op WHEN 'reduce' THEN f.qty - s.qty WHEN 'modify' THEN CASE WHEN f.qty IS NOT NULL THEN coalesce(s.qty, f.qty) END WHEN 'add' THEN coalesce(s.qty, f.qty) END AS q,
               CASE WHEN s.op IN ('add', 'modify') THEN coalesce(s.price, f.price) ELSE f.price END AS p, coalesce(f.since, s.seq) AS t
        FROM f JOIN s ON f.book = s.book AND f.side = s.side AND f.order_id = s.order_id AND s.n = f.n + 1))
SELECT book, side, order_id, price, qty, since FROM (SELECT *, row_number() OVER (PARTITION BY book, side, order_id ORDER BY n DESC) AS place FROM f) WHERE place = 1 AND qty IS NOT NULL""")
def live_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders left in the books; the SQL folds the same messages one by one."""
    return market.live_orders(order_events(spark, sf_dir)).select("book", "side", "order_id", "price", "qty", "since")


@query("""
WITH f AS (SELECT l_orderkey AS order_id, sum(CAST(l_quantity AS BIGINT)) AS cum_qty, sum(CAST(l_quantity AS BIGINT) * CAST(round(l_extendedprice) AS BIGINT)) AS cum_value FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT o_orderkey AS order_id, 100 AS order_qty, CAST(coalesce(cum_qty, 0) AS BIGINT) AS cum_qty, CAST(coalesce(cum_value, 0) AS BIGINT) AS cum_value, CAST(greatest(100 - coalesce(cum_qty, 0), 0) AS BIGINT) AS leaves_qty, cum_value::DOUBLE / cum_qty::DOUBLE AS avg_px
FROM orders LEFT JOIN f ON o_orderkey = order_id""")
def order_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("order_id"), F.col("l_quantity").cast("long").alias("last_qty"), F.round("l_extendedprice").cast("long").alias("last_px"))
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.lit(100).cast("long").alias("order_qty"))
    return orders.roll_up(fills, own)


_OPEN = "IN ('D', 'Q', 'S', 'P')"


@query(f"""
WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
e AS (SELECT user_id || '-' || (n // 12) AS order_id, ['new', 'sent', 'ordered', 'fill', 'modify', 'mod_sent', 'modified', 'fill', 'cancel', 'cxl_sent', 'canceled', 'cxl_reject', 'closed'][n % 12 + 1 + (event_id % 7 = 0)::INTEGER] AS k,
             (event_id % 50 + 1)::DOUBLE AS eq, row_number() OVER (PARTITION BY user_id, n // 12 ORDER BY event_id) AS i FROM p),
s AS (
    SELECT DISTINCT order_id, 0::BIGINT AS i, 'U' AS new, 'U' AS mod, 'U' AS cxl, NULL::DOUBLE AS qty, NULL::DOUBLE AS mod_qty, 0::DOUBLE AS cum, 0::DOUBLE AS value, 0 AS odd FROM e
    UNION ALL
    SELECT order_id, i,
           CASE WHEN k = 'new' AND new = 'U' THEN 'Q' WHEN k = 'sent' AND new = 'Q' THEN 'S' WHEN k = 'reject' AND NOT done THEN 'X' WHEN k = 'closed' THEN 'C' WHEN k = 'canceled' AND NOT done THEN 'C' WHEN may_cxl AND new = 'H' THEN 'C'
                WHEN (k IN ('ordered', 'canceled', 'fill') OR k = 'modified' AND om) AND new IN ('H', 'Q', 'S') THEN 'A' ELSE new END,
           CASE WHEN may_mod THEN CASE WHEN new IN ('Q', 'S') THEN 'D' ELSE 'Q' END WHEN k = 'mod_sent' AND mod = 'Q' THEN 'S' WHEN k = 'ordered' AND mod = 'D' THEN 'Q' WHEN k = 'modified' AND om THEN 'A'
                WHEN (k IN ('mod_reject', 'reject', 'canceled', 'closed') OR may_cxl) AND om THEN 'X' ELSE mod END,
           CASE WHEN may_cxl AND new <> 'H' THEN CASE WHEN new IN ('Q', 'S') THEN 'D' ELSE 'Q' END WHEN k = 'cxl_sent' AND cxl = 'Q' THEN 'S' WHEN k = 'ordered' AND cxl = 'D' THEN 'Q' WHEN k = 'canceled' AND oc THEN 'A'
                WHEN k IN ('cxl_reject', 'reject', 'closed') AND oc THEN 'X' ELSE cxl END,
           CASE WHEN k = 'new' AND new = 'U' THEN eq WHEN k = 'modified' AND om THEN coalesce(mod_qty, qty) ELSE qty END, CASE WHEN may_mod THEN eq ELSE mod_qty END,
           cum + CASE WHEN k = 'fill' THEN eq ELSE 0 END, value + CASE WHEN k = 'fill' THEN eq * 10 ELSE 0 END,
           odd + (k = 'new' AND new <> 'U' OR k = 'ordered' AND new NOT IN ('H', 'Q', 'S') OR k = 'modify' AND NOT may_mod OR k = 'cancel' AND NOT may_cxl OR k IN ('modified', 'mod_reject') AND NOT om OR k = 'cxl_reject' AND NOT oc OR k IN ('canceled', 'reject') AND done)::INTEGER
    FROM (SELECT *, k = 'modify' AND new IN ('H', 'Q', 'S', 'A') AND NOT om AND NOT oc AS may_mod, k = 'cancel' AND new IN ('S', 'Q', 'A', 'H') AND NOT oc AS may_cxl
          FROM (SELECT s.* EXCLUDE (i), e.i, k, eq, new IN ('C', 'X') AS done, mod {_OPEN} AS om, cxl {_OPEN} AS oc FROM s JOIN e ON s.order_id = e.order_id AND e.i = s.i + 1)))
SELECT order_id, new, mod, cxl, qty, cum, value, CASE WHEN new IN ('C', 'X') THEN 0 ELSE greatest(coalesce(qty, 0) - cum, 0) END AS leaves, odd FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY i DESC) AS place FROM s) WHERE place = 1""")
def order_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Life cycles of orders made from events; the SQL goes from state to state, and the tests check the transitions one by one."""
    kinds = F.array(*[F.lit(k) for k in ("new", "sent", "ordered", "fill", "modify", "mod_sent", "modified", "fill", "cancel", "cxl_sent", "canceled", "cxl_reject", "closed")])
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = events(spark, sf_dir, "user_id", "event_id").withColumn("n", place)
    messages = rows.select(F.concat_ws("-", "user_id", F.expr("n div 12")).alias("order_id"), F.col("event_id").alias("seq"), F.element_at(kinds, (F.col("n") % 12 + 1 + (F.col("event_id") % 7 == 0).cast("int")).cast("int")).alias("kind"), (F.col("event_id") % 50 + 1).alias("qty"), F.lit(10).alias("px"), F.lit(None).cast("double").alias("cum"))
    return orders.life_cycles(messages)


# -- streaming jobs over files, run until what is there has been read


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern, as a stream's path may be a folder or a pattern but not one file
    return jobs.files(spark, f"{sf_dir}/event[s].parquet", table(spark, sf_dir, "events").schema).withColumn("at", F.col("ts").cast("timestamp"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event, kept up by exactly-once batches."""
    path = shared_path(spark, "upsert")
    jobs.upsert(_stream(spark, sf_dir).select("user_id", "event_type", "value", "event_id"), f"{path}/rows", f"{path}/checkpoint", ["user_id"], "event_id")
    return jobs.current(spark, f"{path}/rows", ["user_id"], "event_id")


@query("""
WITH n AS (SELECT user_id, event_id, min(event_id) OVER (PARTITION BY user_id) AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)
SELECT user_id, event_id AS seq, CAST(NULL AS BIGINT) AS gap_key, CAST(NULL AS BIGINT) AS gap_length FROM n WHERE event_id - m = n""")
def stream_sequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's numbers as far as they are without a gap; what comes after one waits for it to be filled."""
    path = shared_path(spark, "sequenced")
    jobs.record(jobs.sequenced(_stream(spark, sf_dir).select("user_id", "event_id"), "user_id", "event_id"), f"{path}/rows", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/rows")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream persisted as it comes."""
    path = shared_path(spark, "record")
    jobs.record(_stream(spark, sf_dir).select("event_id", "user_id", "event_type"), f"{path}/rows", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/rows")


@query("""
WITH w AS (SELECT event_type, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY ALL)
SELECT * FROM w WHERE (hour + 1) * 3600000000 <= (SELECT max(epoch_us(ts)) - 3600000000 FROM events)""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that the watermark has closed; the end is told by it, an hour behind the last event."""
    path = shared_path(spark, "windows")
    counted = jobs.windowed(_stream(spark, sf_dir), "at", "1 hour", keys=["event_type"])
    jobs.record(counted.select("begin", "event_type", "n"), f"{path}/rows", f"{path}/checkpoint")
    hour = (micros("begin") / 3_600_000_000).cast("long")
    return spark.read.parquet(f"{path}/rows").withColumn("begin", F.col("begin").cast("timestamp_ntz")).select("event_type", hour.alias("hour"), "n")


@query("""
WITH u AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS book, CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'S' END AS side, event_id % 11 AS price, CASE WHEN event_type = 'error' THEN 0 WHEN event_type IN ('click', 'signup') THEN -(event_id % 5) ELSE event_id % 40 END AS qty, event_type NOT IN ('error', 'view') AS delta FROM events)
SELECT book, max(seq) AS last_seq FROM u GROUP BY book""")
def stream_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each book that a stateful stream has folded; the tests check its levels."""
    path = shared_path(spark, "books")
    kind, n = F.col("event_type"), F.col("event_id")
    qty = F.when(kind == "error", 0).when(kind.isin("click", "signup"), -(n % 5)).otherwise(n % 40)
    updates = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("book"), F.when(n % 2 == 0, "B").otherwise("S").alias("side"), (n % 11).cast("double").alias("price"), qty.cast("double").alias("qty"), (~kind.isin("error", "view")).alias("delta"), n.alias("seq"))
    jobs.upsert(jobs.books(updates), f"{path}/rows", f"{path}/checkpoint", ["book"], "last_seq", "update")
    return jobs.current(spark, f"{path}/rows", ["book"], "last_seq").select("book", "last_seq")
