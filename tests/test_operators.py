"""Operators on small fixtures, and against folds that go row by row."""

import os
import struct
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import keyed, market, orders, rolling, sequence, series
from millrace.plans import QUERIES, SQL, market_queries
from millrace.sources import tables
from millrace.spec import KeySpec, TableSpec

SF = "/root/testdata/sf0.001"


def frame(spark):
    """A frame of 300 rows: an index 0, 1, ... and 42 times it at nine places."""
    return spark.range(300).select(F.col("id").alias("v1"), (F.col("id") * 42).alias("v2"))


@pytest.mark.parametrize("width", [None, 64])
def test_frame_lookup(spark, width):
    rows = series.offsets(frame(spark), "v1", width=width)
    at = series.lower_bound(rows, "v1", 20).first().offset
    assert (at, series.seek(rows, at).orderBy("offset").first().v2) == (20, 840)
    assert series.lower_bound(rows, "v1", 200, at_least=at).first().offset == 200
    assert series.lower_bound(rows, "v1", 100, at_most=200).first().offset == 100
    assert series.lower_bound(rows, "v1", 1000).first().offset is None
    last = rolling.rolling_ranks(rolling.rolling_stats(rows, "v2", ["v1"], 100), "v2", ["v1"], 100, {"median": 0.5, "p95": 0.95}).where("v1 = 299").first()
    assert (last.low, last.high, last.mean, last.median, last.p95) == (200 * 42, 299 * 42, 249.5 * 42, 250 * 42, 295 * 42)
    assert abs(last.var - 42 * 42 * (100 * 100 - 1) / 12) < 1e-6


def test_blocks_end_where_the_scale_changes(spark):
    values = [(42, 0)] * 2 + [(4301, 2), (4302, 2), (43030, 3), (43040, 3), (430500, 4), (430600, 4)] + [(430700, 4)] * 300
    rows = series.offsets(spark.createDataFrame([(i, m, n) for i, (m, n) in enumerate(values)], "at long, m long, ndp int"), "at")
    cut = series.scale_blocks(rows, "at", "ndp")
    assert cut.select("blk").distinct().count() == 4
    number = cut.withColumn("v", F.col("m") / F.pow(F.lit(10), "ndp"))
    assert [series.lower_bound(number, "v", x).first().offset for x in (42.5, 43.02, 44)] == [2, 3, None]
    kept, gone = series.purge(cut, 3)
    assert (kept.select("blk").distinct().count(), kept.orderBy("at").first().m, gone.count()) == (3, 4301, 2)


@pytest.mark.parametrize("width", [None, 7, 1000])
def test_blocks_of_a_long_series_change_nothing(spark, width):
    rows = spark.createDataFrame([(i * i % 97 + 100 * (i // 97), i % 5, "ab"[i % 7 > 3]) for i in range(97)], "at long, v long, s string").dropDuplicates(["at"])
    ordered = rows.orderBy("at").collect()
    total, before, runs = 0, 0, 0
    want = []
    for i, r in enumerate(ordered):
        total += r.v
        runs += i == 0 or ordered[i - 1].s != r.s
        want.append((r["at"], total, r.v - before))
        before = r.v
    got = series.delta(series.running_sum(rows, "at", "v", "t", width=width), "at", "v", "d", width=width)
    assert sorted((r["at"], r.t, r.d) for r in got.collect()) == want
    found = series.run_lengths(rows, "at", "s", width=width).collect()
    assert len(found) == runs and sum(r.length for r in found) == len(ordered)
    assert series.gaps(spark.createDataFrame([(x,) for x in (1, 2, 2, 14, 20)], "k long"), "k", width=width).orderBy("gap_key").collect() == [(3, 11), (15, 5)]


def test_asof_by_blocks(spark):
    probes = spark.createDataFrame([(k, t) for k in "xy" for t in range(0, 100, 7)], "k string, t long")
    rows = spark.createDataFrame([("x", t, t) for t in (5, 14, 14, 60)] + [("y", 50, 1)], "k string, at long, v long")
    for direction, strict in (("forward", False), ("backward", False), ("forward", True), ("backward", True)):
        for width in (None, 10):
            got = {(r.k, r.t): r.right_at for r in series.asof(probes, rows, "t", "at", ["k"], direction, strict, width).collect()}
            for (k, t), at in got.items():
                own = {"x": (5, 14, 60), "y": (50,)}[k]
                ok = [a for a in own if (a > t if strict else a >= t)] if direction == "forward" else [a for a in own if (a < t if strict else a <= t)]
                assert at == (None if not ok else min(ok) if direction == "forward" else max(ok)), (k, t, direction, strict, width)


def test_value_window(spark):
    rows = spark.createDataFrame([(t, -1000010) for t in range(0, 200, 2)], "t long, v long")
    last = rolling.value_window(rows, "t", "v", 10, 10).orderBy(F.desc("bucket")).first()
    assert last.window_mean == -500005
    late = spark.createDataFrame([(1, 10_000_000, 5), (2, 0, 7), (3, 10_000_050, 6)], "n long, t long, v long")
    assert [(r.bucket, r.window_total) for r in rolling.value_window(late, "t", "v", 10, 10, late="n").orderBy("bucket").collect()] == [(1_000_000, 5), (1_000_005, 11)]


def test_keyset_paging_with_nulls_and_mixed_directions(spark):
    rows = spark.createDataFrame([("g", a, b) for a in (None, 1, 2) for b in (None, 5, 7)] + [("h", 1, 1)], "g string, a int, b int")
    key = KeySpec(("g", "a", "b"), 1, frozenset({"b"}))
    whole = [(r.a, r.b) for r in keyed.select_keys(rows, key, ["g"]).collect()]
    assert len(whole) == 9
    for i, at in enumerate(whole):
        assert [(r.a, r.b) for r in keyed.select_keys(rows, key, ["g"], None, at).collect()] == whole[i + 1 :]
        assert [(r.a, r.b) for r in keyed.select_keys(rows, key, ["g"], 2, at, True).collect()] == whole[i : i + 2]


def test_changes(spark):
    spec = TableSpec("t", (KeySpec(("k",)),), mutable=("v",))
    table = spark.createDataFrame([(1, "a", 0, 0), (2, "b", 0, 0)], "k long, v string, _un long, _vn long")
    new = spark.createDataFrame([(2, "x", 1), (3, "c", 2), (3, "d", 3)], "k long, v string, _un long")
    after, bad = keyed.insert(table, new, spec)
    assert sorted((r.k, r.v) for r in after.collect()) == [(1, "a"), (2, "b"), (3, "c")] and sorted(r._un for r in bad.collect()) == [1, 3]
    changes = spark.createDataFrame([(1, None, 4, ["v"]), (2, None, 5, None), (9, "z", 6, None), (2, "q", 7, None)], "k long, v string, _un long, _reset array<string>")
    after, bad = keyed.update(after, changes, spec)
    assert sorted((r.k, r.v, r._vn) for r in after.collect()) == [(1, None, 1), (2, "q", 2), (3, "c", 0)] and [r.k for r in bad.collect()] == [9]
    after, tombs = keyed.delete(after, spark.createDataFrame([(2, 8)], "k long, _un long"), spec)
    assert sorted(r.k for r in after.collect()) == [1, 3] and [(r.k, r._vn) for r in tombs.collect()] == [(2, -3)]


def test_live_orders_against_a_fold(spark):
    books = defaultdict(dict)
    for e in market_queries.order_events(spark, SF).orderBy("seq").collect():
        book, at = books[e.book], (e.side, e.order_id)
        if e.op == "reset":
            book.clear()
        elif e.op == "cancel":
            book.pop(at, None)
        elif e.op == "reduce":
            if at in book:
                book[at][1] -= e.qty
        elif (e.op == "add" and e.qty is not None) or at in book:
            old = book.get(at)
            book[at] = [e.price if e.price is not None or old is None else old[0], e.qty if e.qty is not None else old[1]]
        if at in book and book[at][1] <= 0:
            del book[at]  # a removed order is unknown to what follows
    want = sorted((b, s, i, p, q) for b, book in books.items() for (s, i), (p, q) in book.items())
    got = sorted(tuple(r)[:5] for r in market_queries.live_orders(spark, SF).collect())
    key = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else v for v in x)
    assert sorted(got, key=key) == sorted(want, key=key)


LIVES = {
    "reduced to nought": ([("add", 1, 5), ("reduce", None, 5), ("modify", None, 3)], None),
    "modified to nought": ([("add", 1, 5), ("modify", None, 0), ("modify", None, 4)], None),
    "reduced below nought": ([("add", 1, 5), ("reduce", None, 9), ("reduce", None, -9)], None),
    "added again": ([("add", 1, 5), ("reduce", None, 5), ("modify", None, 3), ("add", None, 4)], (None, 4, 3)),
    "added while live": ([("add", 1, 5), ("add", None, 6), ("reduce", None, 2)], (1, 4, 0)),
    "added without a quantity": ([("add", 1, None), ("modify", None, 3)], None),
    "added with nought": ([("add", 1, 5), ("add", 2, 0)], None),
    "canceled and added": ([("add", 1, 5), ("cancel", None, None), ("add", 2, 7), ("modify", 3, None)], (3, 7, 2)),
    "modified in between": ([("add", 1, 5), ("modify", 2, 8), ("reduce", None, 3), ("modify", None, None)], (2, 5, 0)),
    "unknown": ([("modify", 2, 8), ("reduce", None, 3)], None),
}


def test_lives_of_orders(spark):
    rows = [("b", "B", name, op, price, qty, None, i) for name, (ops, _) in LIVES.items() for i, (op, price, qty) in enumerate(ops)]
    got = market.live_orders(spark.createDataFrame(rows, "book string, side string, order_id string, op string, price int, qty int, rank int, seq int"))
    assert {r.order_id: (r.price, r.qty, r.since) for r in got.collect()} == {k: v for k, (_, v) in LIVES.items() if v}


def brute_match(resting, takers):
    queue = sorted(([(p is not None, p if s == "S" else -p) if p is not None else (False, 0), i, s, p, q] for i, (s, p, q) in enumerate(resting)), key=lambda x: x[:2])
    fills, left = [], []
    for t, (side, qty, limit) in enumerate(takers):
        for x in queue:
            ok = x[2] != side and (limit is None or x[3] is None or (x[3] <= limit if side == "B" else x[3] >= limit))
            if ok and (n := min(qty, x[4])) > 0:
                x[4] -= n
                qty -= n
                fills.append((x[1], t, n, x[4]))
        left.append((t, qty))
    return sorted(fills), sorted(left)


def test_match_of_several_aggressors(spark):
    import random

    draw = random.Random(4)
    for n in (1, 2, 7, 40):
        resting = [(draw.choice("BS"), draw.choice([None, *range(5, 15)]), draw.randint(1, 9)) for _ in range(30)]
        takers = [(draw.choice("BS"), draw.randint(1, 20), draw.choice([None, *range(4, 16)])) for _ in range(n)]
        orders_ = spark.createDataFrame([("b", s, i, p, q, None, i) for i, (s, p, q) in enumerate(resting)], "book string, side string, order_id int, price int, qty int, rank int, since int")
        hits = spark.createDataFrame([("b", s, q, p, t) for t, (s, q, p) in enumerate(takers)], "book string, side string, qty int, price int, t int")
        fills, leaves = market.match(orders_, hits, seq="t")
        want = brute_match(resting, takers)
        assert (sorted((r.order_id, r.t, r.fill, r.rest) for r in fills.collect()), sorted((r.t, r.left) for r in leaves.collect())) == want
    two = spark.createDataFrame([("b", "B", 4, None, 1), ("b", "B", 4, None, 2)], "book string, side string, qty int, price int, t int")
    fills, leaves = market.match(spark.createDataFrame([("b", "S", 1, 9, 5, None, 1)], orders_.schema), two, seq="t")
    assert sorted((r.t, r.left) for r in leaves.collect()) == [(1, 0), (2, 3)] and sum(r.fill for r in fills.collect()) == 5


def test_alert_numbers_go_on(spark, tmp_path):
    from datetime import datetime

    path = str(tmp_path / "alerts")
    write = lambda *at: tables.write_alerts(spark.createDataFrame([(datetime(*a), str(a)) for a in at], "ts timestamp, text string"), path)
    write((2024, 1, 1, 5), (2024, 1, 1, 5, 1), (2024, 1, 1, 9), (2024, 1, 2, 1))
    write((2024, 1, 1, 3), (2024, 1, 1, 7), (2024, 1, 3, 1))
    got = spark.read.parquet(path).orderBy("yyyymmdd", "seq_no").collect()
    assert [(r.yyyymmdd, r.seq_no) for r in got] == [(20240101, n) for n in range(5)] + [(20240102, 0), (20240103, 0)]
    assert [r.ts.hour for r in got[:5]] == [5, 5, 9, 3, 7]
    assert tables.recent_alerts(spark, path, 20240102).count() == 2


def test_match_takes_price_then_time(spark):
    resting = spark.createDataFrame([("b", "S", i, p, q, None, i) for i, (p, q) in enumerate([(10, 5), (9, 5), (9, 7), (11, 5), (None, 2)])], "book string, side string, order_id int, price int, qty int, rank int, since int")
    fills, leaves = market.match(resting, spark.createDataFrame([("b", "B", 17, 10)], "book string, side string, qty int, price int"))
    assert sorted((r.order_id, r.fill, r.rest) for r in fills.collect()) == [(0, 3, 2), (1, 5, 0), (2, 7, 0), (4, 2, 0)]
    assert leaves.first().left == 0
    _, leaves = market.match(resting, spark.createDataFrame([("b", "B", 100, None)], "book string, side string, qty int, price int"))
    assert leaves.first().left == 76


CYCLES = {
    "plain": (["new", "sent", "ordered", ("fill", 4, 10.0, None), "canceled"], ("C", "U", "U", 4.0, 0.0, 0)),
    "filled": ([("new", 10, None, None), "sent", ("fill", 6, 2.0, None), ("fill", 4, 3.0, None), "closed"], ("C", "U", "U", 10.0, 0.0, 0)),
    "rejected": (["new", "sent", "reject"], ("X", "U", "U", 0.0, 0.0, 0)),
    "modified": (["new", "sent", "ordered", ("modify", 20, None, None), "mod_sent", "modified"], ("A", "A", "U", 0.0, 20.0, 0)),
    "modify waits for its fills": (["new", "sent", "ordered", ("modify", 20, None, None), "mod_sent", ("modified", None, None, 5.0), ("fill", 5, 1.0, None)], ("A", "A", "U", 5.0, 15.0, 0)),
    "deferred cancel": (["new", "sent", "cancel", "ordered", "cxl_sent", "canceled"], ("C", "U", "A", 0.0, 0.0, 0)),
    "cancel rejects a modify": (["new", "sent", "ordered", ("modify", 20, None, None), "cancel", "cxl_sent", "cxl_reject"], ("A", "X", "X", 0.0, 10.0, 0)),
    "odd": (["ordered", "new", "new", "modified"], ("Q", "U", "U", 0.0, 10.0, 3)),
}


@pytest.mark.parametrize("name", CYCLES)
def test_order_life_cycles(spark, name):
    events, want = CYCLES[name]
    rows = [(1, i, *(e if isinstance(e, tuple) else (e, 10 if e == "new" else None, None, None))) for i, e in enumerate(events)]
    got = orders.life_cycles(spark.createDataFrame(rows, "order_id int, seq int, kind string, qty int, px double, cum double")).first()
    assert (got.new, got["mod"], got.cxl, got.cum, got.leaves, got.odd) == want


def test_sequence_runs(spark):
    runs = spark.createDataFrame([(1, 3), (2, 5), (3, 2), (10, 4), (12, 10)], "b long, n long")
    assert [(r.b, r.n) for r in sequence.clip_overlaps(runs, "b", "n").orderBy("b").collect()] == [(1, 3), (4, 3), (10, 4), (14, 8)]
    assert [(r.b, r.n) for r in sequence.clip_overlaps(runs, "b", "n", head=3).orderBy("b").collect()] == [(3, 1), (4, 3), (10, 4), (14, 8)]


def test_bands_and_hierarchy(spark):
    ticks = spark.createDataFrame([("t", 0.0, 10.0, 0.1), ("t", 10.0, None, 0.5)], "tbl string, min_price double, max_price double, tick_size double")
    prices = spark.createDataFrame([("t", 10.0), ("t", 1e6), ("t", -1.0), ("u", 5.0), ("t", 10.0)], "tbl string, px double")
    assert sorted((r.tbl, r.px, r.tick_size or 0) for r in market.bands(ticks, prices, "px").collect()) == [("t", -1.0, 0), ("t", 10.0, 0.1), ("t", 10.0, 0.1), ("t", 1e6, 0.5), ("u", 5.0, 0)]
    wide = spark.createDataFrame([("t", 0.0, None, 1.0), ("t", 5.0, 9.0, 2.0), ("t", -3.0, 6.0, 3.0), (None, 0.0, 1.0, 9.0)], ticks.schema)
    far = spark.createDataFrame([("t", 5e11), ("t", 6.0), ("t", 7.0), ("t", None), (None, 0.5)], prices.schema)
    assert sorted((r.px or 0, r.tick_size or 0) for r in market.bands(wide, far, "px").collect()) == [(0, 0), (0.5, 0), (6.0, 3.0), (7.0, 1.0), (5e11, 1.0)]
    rows = spark.createDataFrame([("v", "s", "i"), ("v", "s", "j"), ("v", "t", "i"), ("w", "s", "i")], "v string, s string, i string")
    pick = lambda wanted: sorted(map(tuple, market.hierarchical(rows, spark.createDataFrame(wanted, rows.schema), ["v", "s", "i"]).collect()))
    assert pick([("v", "s", None), ("v", "s", "i"), ("w", None, None)]) == [("v", "s", "i"), ("v", "s", "j"), ("w", "s", "i")]
    assert len(pick([])) == 4


def test_csv_and_captures(spark, tmp_path):
    (tmp_path / "x.csv").write_text('func,string,int,flag\nignored, "a ""quoted"", cell",42,Y\n\n,,,\nf,plain,x,no\n')
    from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

    from millrace.functions import texts

    schema = StructType([StructField("int", IntegerType()), StructField("string", StringType()), StructField("flag", BooleanType()), StructField("more", StringType())])
    got = tables.read_csv(spark, str(tmp_path / "x.csv"), schema, {"int": -1, "more": "none"}, {"flag": texts.to_bool}).collect()
    assert [tuple(r) for r in got] == [(42, 'a "quoted", cell', True, "none"), (-1, "plain", False, "none")]
    body = b"".join(struct.pack("<HHqI", len(b), 1, 100 + i, i) + b for i, b in enumerate([b"one", b"", b"three"]))
    (tmp_path / "a.cap").write_bytes(body + struct.pack("<HHqI", 99, 1, 1, 1) + b"cut off")
    assert [(r.sec, bytes(r.body), r.number) for r in tables.read_records(spark, str(tmp_path / "a.cap")).orderBy("number").collect()] == [(100, b"one", 0), (101, b"", 1), (102, b"three", 2)]
    head = struct.pack("<I12sHH", tables.EVENT_MAGIC, b"RMD", 6, 0)
    (tmp_path / "b.log").write_bytes(head + struct.pack("<QIHBB", 7, 5, 2, 3, 255) + b"hi")
    read = lambda f: [(r.seq_no, r.type, bytes(r.body)) for r in tables.read_records(spark, str(tmp_path / f), tables.EVENT, tables.EVENT_HEADER, tables.EVENT_MAGIC).collect()]
    assert read("b.log") == [(7, 3, b"hi")] and read("a.cap") == []


def test_telemetry_names(spark):
    rows = spark.createDataFrame([("heap.a",), ("heap.b",), ("hash",)], "id string")
    assert [tables.named(rows, "id", p).count() for p in ("", "*", "*x", "heap.*", "hash", "h")] == [3, 3, 3, 2, 1, 0]


def test_stores(spark, tmp_path):
    spec = TableSpec("t", (KeySpec(("id",)),))
    for store in (tables.MemoryStore(), tables.ParquetStore(spark, str(tmp_path))):
        store.write(spec, spark.range(3))
        store.write(spec, spark.range(3, 5))
        assert sorted(r.id for r in store.read(spec).collect()) == [0, 1, 2, 3, 4]


def test_instruments_by_name(spark):
    rows = spark.createDataFrame([("A", "V", "x", 1, None, 1), ("A", "W", "x", 1, "P", 2), ("B", "V", "y", 2, None, 3)], "symbol string, venue string, segment string, maturity int, put_call string, book int")
    assert [market.lookup(rows, *a, **k).count() for a, k in (((["A"],), {}), ((), {}), ((["A", "B"],), {"venue": "V"}), ((["A"],), {"put_call": "P", "maturity": 1}), ((["C"],), {}))] == [2, 3, 2, 1, 0]
    levels = spark.createDataFrame([(1, "B", 5, 10), (3, "S", 6, 1), (9, "S", 7, 1)], "book int, side string, price int, qty int")
    assert {(r.symbol, r.price) for r in market.quotes(levels, market.lookup(rows, ["A"])).collect()} == {("A", 5)}
    states = spark.createDataFrame([("V", "x", "open", 1), ("V", "x", "closed", 5), ("V", "y", "open", 2)], "venue string, segment string, session string, seq int")
    assert {(r.segment, r.session) for r in market.sessions(states).collect()} == {("x", "closed"), ("y", "open")}


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_ranks_where_rows_come_in_any_order(spark, reuse):
    """Each reading deals the rows anew, as fetches from many machines do."""
    rng = np.random.default_rng()

    def dealt(batches):
        for b in batches:
            yield b.sample(frac=1, random_state=int(rng.integers(1 << 30)) ^ int.from_bytes(os.urandom(3), "big"))

    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        rows = spark.range(0, 60_000, 1, 6).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.expr("sqrt(id div 2)").alias("v")).mapInPandas(dealt, "k long, v double")
        got = {r.k: (r.median, r.p95) for r in rolling.ranks(rows, "v", {"median": 0.5, "p95": 0.95}, ["k"]).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    want = {}
    for k in range(3):
        v = sorted((i // 2) ** 0.5 for i in range(60_000) if i % 3 == k)
        want[k or None] = (v[len(v) // 2], v[int(len(v) * 0.95)])
    assert got == want


def test_intervals_over_a_long_total(spark):
    rows = spark.createDataFrame([("a", 0, 1 << 62), ("a", 1, 1 << 62), ("a", 2, 1 << 62), ("b", 5, None)], "k string, b long, e long")
    got = {r.k: tuple(r)[1:] for r in rolling.intervals(rows, "b", "e", ["k"]).collect()}
    total = 3 * (1 << 62) - 3
    assert got == {"a": (3, (1 << 62) - 2, 1 << 62, total, total / 3), "b": (0, 0, 0, 0, 0.0)}


def test_interval_stats_over_a_long_total(spark, tmp_path):
    spark.sql("SELECT id AS o_orderkey, timestamp'0001-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(100)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT id AS l_orderkey, timestamp'9999-01-01' AS l_shipdate FROM range(100)").write.parquet(f"{tmp_path}/lineitem.parquet")
    row = QUERIES["interval_stats"](spark, str(tmp_path)).first()
    assert (row.n, row.total, row.mean) == (100, None, row.longest)


def test_match_reads_no_frame_anew_for_each_row(spark):
    resting = spark.range(50_000).select(F.lit("b").alias("book"), F.lit("S").alias("side"), F.col("id").alias("order_id"), F.lit(9).alias("price"), (F.col("id") % 2).alias("qty"), F.lit(None).cast("int").alias("rank"), F.col("id").alias("since"))
    fills, leaves = market.match(resting, spark.createDataFrame([("b", "B", 20_000, None)], "book string, side string, qty long, price int"))
    assert "unboundedfollowing" not in fills._jdf.queryExecution().executedPlan().toString().lower()
    assert sorted((r.order_id, r.fill, r.rest) for r in fills.collect()) == [(i, 1, 0) for i in range(1, 40_000, 2)]
    assert leaves.first().left == 0


def test_decimal_arithmetic_rounds_quantities_as_its_sql(spark, tmp_path):
    spark.sql("SELECT double(p) AS l_extendedprice, double(q) AS l_quantity FROM VALUES (10.01, 2.5), (10.01, 2), (7.5, 3.5), (0.03, 7) AS t(p, q)").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = QUERIES["decimal_arithmetic"](spark, str(tmp_path)).select("p", "q", "product", "quotient_mantissa", "whole")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(SQL["decimal_arithmetic"]).fetchall())
