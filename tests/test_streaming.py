"""Streaming jobs against batch folds of the same rows."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import market
from millrace.plans import market_queries
from millrace.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture
def feed(spark, tmp_path):
    """Rows dealt into files that a stream reads one by one."""

    def make(rows, schema):
        for i, part in enumerate(rows):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))

    return make


def test_sequenced_orders_drops_and_waits(spark, feed, tmp_path):
    stream = feed([[(1, 3), (1, 1)], [(1, 2), (1, 2), (2, 7)], [(1, 6), (1, 1), (2, 8)], [(1, 4), (1, 5)]], "k long, n long")
    jobs.record(jobs.sequenced(stream, "k", "n"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("k", "seq").collect())
    assert got == [(1, n) for n in range(1, 7)] + [(2, 7), (2, 8)]


def test_books_against_the_batch_fold(spark, feed, tmp_path):
    rows = market_queries.level_updates(spark, SF).where("book < 4").select(F.col("book").cast("string"), "side", F.col("price").cast("double"), F.col("qty").cast("double"), "delta", "seq")
    every = rows.collect()
    ordered = sorted((tuple(r) for r in every), key=lambda r: r[5])
    half = len(ordered) // 2
    stream = feed([ordered[:half], ordered[half:]], "book string, side string, price double, qty double, delta boolean, seq long")
    jobs.upsert(jobs.books(stream), str(tmp_path / "rows"), str(tmp_path / "cp"), ["book"], "last_seq", "update")
    got = {r.book: (r.bid, r.ask) for r in jobs.current(spark, str(tmp_path / "rows"), ["book"], "last_seq").collect()}
    # deltas on a level that an earlier one emptied begin at nought in the stream, so the levels are folded one by one here
    want = {}
    levels = {}
    for book, side, price, qty, delta, _ in ordered:
        q = qty + (levels.get((book, side, price), 0) if delta else 0)
        levels[book, side, price] = q
        if q <= 0:
            del levels[book, side, price]
    for b in {r[0] for r in ordered}:
        want[b] = (max((p for k, s, p in levels if k == b and s == "B"), default=None), min((p for k, s, p in levels if k == b and s == "S"), default=None))
    assert got == want
    assert market.fold_levels(rows).count() > 0


def test_dedup_within_the_watermark(spark, feed, tmp_path):
    stream = feed([[(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00")], [(1, "2024-01-01 00:02:00"), (2, "2024-01-01 00:00:00")]], "k long, t string").withColumn("at", F.to_timestamp("t"))
    jobs.record(jobs.deduped(stream, "at", ["k"]).select("k"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_a_replayed_batch_adds_nothing(spark, feed, tmp_path):
    stream = feed([[(1, 1, "a"), (2, 2, "b")], [(1, 3, "c")]], "k long, n long, v string")
    for checkpoint in ("one", "two"):
        jobs.upsert(stream, str(tmp_path / "rows"), str(tmp_path / checkpoint), ["k"], "n")
    assert sorted(tuple(r) for r in jobs.current(spark, str(tmp_path / "rows"), ["k"], "n").collect()) == [(1, 3, "c"), (2, 2, "b")]
