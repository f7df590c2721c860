"""Sequenced streams: dedup and reordering, merging, snapshot hand-over, event time, timers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import series


def dedup(df: DataFrame, seq: str, keys: Sequence[str] = (), arrival: str | None = None) -> DataFrame:
    """One row for each number: the first to arrive."""
    if arrival is None:
        return df.dropDuplicates([*keys, seq])
    rest = [c for c in df.columns if c not in (*keys, seq)]
    return df.groupBy(*keys, seq).agg(F.min_by(F.struct(*rest), arrival).alias("_row")).select(*keys, seq, "_row.*")


def reorder(df: DataFrame, seq: str, keys: Sequence[str] = (), head: int | None = None, arrival: str | None = None) -> DataFrame:
    """Distinct rows in order; those before ``head`` are late and left out."""
    found = dedup(df, seq, keys, arrival)
    found = found if head is None else found.where(F.col(seq) >= head)
    return found.orderBy(*keys, seq)


def clip_overlaps(df: DataFrame, begin: str, length: str, keys: Sequence[str] = (), head: int | None = None) -> DataFrame:
    """Runs of numbers (begin, length) with what earlier runs cover taken off; empty ones go."""
    w = Window.partitionBy(*keys).orderBy(begin, F.desc(length)).rowsBetween(Window.unboundedPreceding, -1)
    covered = F.max(F.col(begin) + F.col(length)).over(w)
    low = F.greatest(F.col(begin), F.coalesce(covered, F.col(begin)), *([F.lit(head)] if head is not None else []))
    clipped = df.withColumn("_low", low).withColumn(length, F.col(begin) + F.col(length) - F.col("_low")).withColumn(begin, F.col("_low"))
    return clipped.where(F.col(length) > 0).drop("_low")


def first_gap(df: DataFrame, seq: str, keys: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """The first missing range of each key."""
    found = series.gaps(df, seq, keys, width)
    return found.groupBy(*keys).agg(F.min(F.struct("gap_key", "gap_length")).alias("_g")).select(*keys, "_g.*")


def hand_over(snapshot: DataFrame, increments: DataFrame, seq: str, snapshot_seq: str, keys: Sequence[str] = ()) -> DataFrame:
    """A snapshot's rows and the increments after the number that it was taken at."""
    taken = snapshot.groupBy(*keys).agg(F.max(snapshot_seq).alias("_taken"))
    later = increments.join(taken, list(keys), "left") if keys else increments.crossJoin(F.broadcast(taken))  # one row
    return snapshot.drop(snapshot_seq).unionByName(later.where(F.col("_taken").isNull() | (F.col(seq) > F.col("_taken"))).drop("_taken"), allowMissingColumns=True)


def merge(parts: Sequence[DataFrame], at: Sequence[str]) -> DataFrame:
    """All rows of the captures in the order of their stamps, then of the captures."""
    marked = [p.withColumn("source_rank", F.lit(i)) for i, p in enumerate(parts)]
    found = marked[0]
    for part in marked[1:]:
        found = found.unionByName(part)
    return found.orderBy(*at, "source_rank")


def event_time(df: DataFrame, order: str, heartbeat: str, nsec: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``event_ns``: the last heartbeat's stamp plus the row's nanoseconds."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("event_ns", F.last(heartbeat, ignorenulls=True).over(w) + F.col(nsec))


def timers(df: DataFrame, at: str, step: int, keys: Sequence[str] = ()) -> DataFrame:
    """(key, fires_at): the multiples of ``step`` that event time passes, from the first row to the last."""
    span = df.groupBy(*keys).agg((F.floor(F.min(at) / step) + 1).alias("_from"), F.floor(F.max(at) / step).alias("_to"))
    return span.where(F.col("_from") <= F.col("_to")).select(*keys, F.explode(F.sequence("_from", "_to")).alias("_tick")).select(*keys, (F.col("_tick") * step).alias("fires_at"))


def paced(df: DataFrame, at: str, speed: float, interval: int, begin: int | None = None, width: int | None = None) -> DataFrame:
    """Adds ``due``: when a replay at ``speed`` with ``interval`` between rows would send each row; rows before ``begin`` go.

    Rows are numbered in blocks of ``width`` of ``at``.
    """
    kept = df if begin is None else df.where(F.col(at) >= begin)
    numbered = series.offsets(kept, at, width=width)
    first = kept.agg(F.min(at).alias("_start"))
    return numbered.crossJoin(F.broadcast(first)).withColumn("due", (F.col(at) - F.col("_start")) / speed + F.col("offset") * interval).drop("_start", "offset")  # one row


def after_barrier(df: DataFrame, order: str, barrier: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Rows from each key's first ``barrier`` row on, as reference data is loaded up to it; a key without one has none."""
    first = df.where(barrier).groupBy(*keys).agg(F.min(order).alias("_barrier"))
    joined = df.join(first, list(keys)) if keys else df.crossJoin(F.broadcast(first))  # one row
    return joined.where(F.col(order) >= F.col("_barrier")).drop("_barrier")
