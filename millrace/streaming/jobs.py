"""Structured Streaming jobs: windows with watermarks, dedup, exactly-once upserts, stateful books, timers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def files(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed(stream: DataFrame, at: str, width: str, slide: str | None = None, late: str = "1 hour", keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Counts and sums of event-time windows; rows later than ``late`` are dropped."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("begin"), F.col("window.end").alias("until"), *keys, "n", "total")


def deduped(stream: DataFrame, at: str, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def upsert(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: str, mode: str = "append") -> None:
    """Keeps in ``path`` each key's last row; a batch that runs again writes the same folder again.

    Every batch writes its last rows per key into a folder of its own number, so
    a replay overwrites and adds nothing; ``current`` folds the folders.
    """

    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_x")).select(*keys, "_x.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, path: str, keys: Sequence[str], order: str) -> DataFrame:
    """Each key's last row over all batches."""
    every = spark.read.parquet(path).drop("batch")
    rest = [c for c in every.columns if c not in keys]
    return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_x")).select(*keys, "_x.*")


def record(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends the stream to Parquet, exactly once, until what is there has been read."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def sequenced(stream: DataFrame, key: str, seq: str, wait_ms: int | None = None) -> DataFrame:
    """Numbers of each key in order, with the gaps before them.

    Numbers that come early wait in the state until the gap is filled; repeated
    and late ones go. After ``wait_ms`` without any row of the key, the lowest
    that wait are let through and the gap is given up. Emits key, seq, gap_key
    and gap_length, which are null without a gap.
    """
    output = f"{key} long, seq long, gap_key long, gap_length long"
    timeout = GroupStateTimeout.ProcessingTimeTimeout if wait_ms is not None else GroupStateTimeout.NoTimeout

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        head, waiting = state.get if state.exists else (None, [])
        held = set(waiting)
        for part in parts:
            held.update(int(x) for x in part[seq])
        out = []
        expired = state.hasTimedOut
        if head is None and held:
            head = min(held)
        while held:
            low = min(held)
            if low < head:
                held.discard(low)
            elif low == head or expired:
                out.append((group[0], low, head if low > head else None, low - head if low > head else None))
                held.discard(low)
                head, expired = low + 1, expired and low == head
            else:
                break
        state.update((head, sorted(held)))
        if wait_ms is not None and held:
            state.setTimeoutDuration(wait_ms)
        yield pd.DataFrame(out, columns=[key, "seq", "gap_key", "gap_length"])

    return stream.groupBy(key).applyInPandasWithState(run, output, "head long, waiting array<long>", "append", timeout)


def books(stream: DataFrame) -> DataFrame:
    """Best bid and ask of each book after each batch, from level updates (book, side, price, qty, delta, seq).

    The state is the book's live levels. Updates of a batch are taken by seq.
    """
    output = "book string, last_seq long, bid double, bid_qty double, ask double, ask_qty double"

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, sides, prices, amounts = state.get if state.exists else (-1, [], [], [])
        levels = {(s, p): q for s, p, q in zip(sides, prices, amounts, strict=True)}
        for u in pd.concat(list(parts)).sort_values("seq").itertuples():
            if u.seq <= last:
                continue
            at, last = (u.side, float(u.price)), int(u.seq)
            q = float(u.qty) + (levels.get(at, 0.0) if u.delta else 0.0)
            if q > 0:
                levels[at] = q
            else:
                levels.pop(at, None)
        keys = sorted(levels)
        state.update((last, [k[0] for k in keys], [k[1] for k in keys], [levels[k] for k in keys]))
        bid = max((p for s, p in keys if s == "B"), default=None)
        ask = min((p for s, p in keys if s == "S"), default=None)
        yield pd.DataFrame([(group[0], last, bid, levels.get(("B", bid)), ask, levels.get(("S", ask)))], columns=["book", "last_seq", "bid", "bid_qty", "ask", "ask_qty"])

    return stream.groupBy("book").applyInPandasWithState(run, output, "last long, sides array<string>, prices array<double>, amounts array<double>", "update", GroupStateTimeout.NoTimeout)
