"""Ordered series: offsets, lower bounds, as-of joins, differences and sums, runs, gaps, retention.

A series is a DataFrame ordered by ``order`` within ``keys``. With ``width`` a
numeric order is cut into blocks of that width, and what must cross a block's
border (a total, the last row before it) is taken from one row per block; a
single long series then needs no task that sees all of it. A series without keys
whose order is a number is cut by ``WIDTH`` if no width is given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

BLOCK = "_block"
WIDTH = 1 << 16


def _width(df: DataFrame, order: str, keys: Sequence[str], width: int | None) -> int | None:
    return width or (WIDTH if not keys and isinstance(df.schema[order].dataType, NumericType) else None)


def blocks(df: DataFrame, order: str, width: int | None) -> DataFrame:
    return df.withColumn(BLOCK, F.floor(F.col(order) / width) if width else F.lit(0))


def running_sum(df: DataFrame, order: str, value: str, name: str, keys: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` up to and with each row."""
    width = _width(df, order, keys, width)
    cut = blocks(df, order, width)
    own = Window.partitionBy(*keys, BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumn(name, F.sum(value).over(own))
    if not width:
        return summed.drop(BLOCK)
    totals = cut.groupBy(*keys, BLOCK).agg(F.sum(value).alias("_total"))
    before = totals.withColumn("_before", F.sum("_total").over(Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)))
    return summed.join(before.drop("_total"), [*keys, BLOCK]).withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop(BLOCK, "_before")


def previous(df: DataFrame, order: str, value: str, name: str, keys: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """Adds ``name``: ``value`` of the row before, null on the first."""
    width = _width(df, order, keys, width)
    cut = blocks(df, order, width)
    lagged = cut.withColumn(name, F.lag(value).over(Window.partitionBy(*keys, BLOCK).orderBy(order)))
    if not width:
        return lagged.drop(BLOCK)
    ends = cut.groupBy(*keys, BLOCK).agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("_last"), F.min(order).alias("_first"))
    before = ends.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy(BLOCK)))
    joined = lagged.join(before.select(*keys, BLOCK, "_before", "_first"), [*keys, BLOCK])
    return joined.withColumn(name, F.when(F.col(order) == F.col("_first"), F.col("_before.v")).otherwise(F.col(name))).drop(BLOCK, "_before", "_first")


def delta(df: DataFrame, order: str, value: str, name: str, keys: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """Adds ``name``: the difference from the value before, which is 0 before the first."""
    return previous(df, order, value, "_previous", keys, width).withColumn(name, F.col(value) - F.coalesce("_previous", F.lit(0))).drop("_previous")


def delta2(df: DataFrame, order: str, value: str, name: str, keys: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """Adds ``name``: the difference of the differences."""
    once = delta(df, order, value, "_delta", keys, width)
    return delta(once, order, "_delta", name, keys, width).drop("_delta")


def run_lengths(df: DataFrame, order: str, value: str, keys: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """Runs of equal values: first and last place, length, value."""
    marked = previous(df.withColumn("_seen", F.struct(F.col(value).alias("v"))), order, "_seen", "_previous", keys, width)
    new = F.col("_previous").isNull() | ~F.col(value).eqNullSafe(F.col("_previous.v"))
    numbered = running_sum(marked.withColumn("_new", new.cast("long")), order, "_new", "run", keys, width)
    return numbered.groupBy(*keys, "run").agg(
        F.min(order).alias("first_at"), F.max(order).alias("last_at"), F.count(F.lit(1)).alias("length"), F.first(value).alias(value)
    )


def offsets(df: DataFrame, order: str, keys: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """Adds ``offset``: how many rows come before each."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", "offset", keys, width).withColumn("offset", F.col("offset") - 1).drop("_one")


def seek(df: DataFrame, offset: int) -> DataFrame:
    """Rows from ``offset`` on."""
    return df.where(F.col("offset") >= offset)


def seek_back(df: DataFrame, offset: int) -> DataFrame:
    """Rows up to ``offset``."""
    return df.where(F.col("offset") <= offset)


def lower_bound(df: DataFrame, index: str, value: object, at_least: int | None = None, at_most: int | None = None) -> DataFrame:
    """The offset of the first row with ``index`` >= ``value``, between two offsets; null if there is none."""
    found = df.where(F.col(index) >= F.lit(value))
    if at_least is not None:
        found = found.where(F.col("offset") >= at_least)
    if at_most is not None:
        found = found.where(F.col("offset") <= at_most)
    return found.agg(F.min("offset").alias("offset"))


def asof(probes: DataFrame, series: DataFrame, probe_at: str, at: str, keys: Sequence[str] = (), direction: str = "forward", strict: bool = False, width: int | None = None, unit: Column | None = None) -> DataFrame:
    """Each probe with the nearest series row at or after it (``forward``) or at or before it (``backward``).

    Both sides are merged into one ordered stream and the nearest row is carried
    over it, so there is no pair per match. With ``width`` the stream is cut into
    blocks of that many units of ``unit`` (a number made from ``_at``), and a
    probe whose block has no row takes the border row of the next block with
    any. Of series rows at one place the least is taken. Columns of the series
    are prefixed with ``right_``.
    """
    names = [c for c in series.columns if c not in keys]
    rows = series.select(*keys, F.col(at).alias("_at"), F.struct(*[F.col(c).alias(f"right_{c}") for c in names]).alias("_row")).groupBy(*keys, "_at").agg(F.min("_row").alias("_row"))
    left = probes.select(*keys, F.col(probe_at).alias("_at"), F.struct(*[c for c in probes.columns if c not in keys]).alias("_probe"))
    both = left.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)).unionByName(rows.withColumn("_probe", F.lit(None).cast(left.schema["_probe"].dataType)))
    forward = direction == "forward"
    number = unit if unit is not None else F.col("_at")
    both = both.withColumn(BLOCK, F.floor(number / width) if width else F.lit(0))
    # rows at a probe's own place come before it in the walk unless the comparison is strict
    own_first = F.col("_probe").isNotNull() if not strict else F.col("_probe").isNull()
    order = [F.desc("_at") if forward else F.asc("_at"), own_first]
    walk = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_near", F.last("_row", ignorenulls=True).over(walk))
    if width:
        step = Window.partitionBy(*keys).orderBy(F.desc(BLOCK) if forward else F.asc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
        borders = both.groupBy(*keys, BLOCK).agg(F.min_by("_row", F.when(F.col("_row").isNotNull(), F.col("_at"))).alias("_edge") if forward else F.max_by("_row", F.when(F.col("_row").isNotNull(), F.col("_at"))).alias("_edge"))
        borders = borders.withColumn("_border", F.last("_edge", ignorenulls=True).over(step)).drop("_edge")
        carried = carried.join(borders, [*keys, BLOCK]).withColumn("_near", F.coalesce("_near", "_border"))
    return carried.where(F.col("_probe").isNotNull()).select(*keys, "_probe.*", "_near.*")


def gaps(df: DataFrame, order: str, keys: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """Missing ranges (key, length) between the distinct numbers of ``order``."""
    distinct = df.select(*keys, order).distinct()
    marked = previous(distinct, order, order, "_previous", keys, width)
    return marked.where(F.col(order) - F.col("_previous") > 1).select(*keys, (F.col("_previous") + 1).alias("gap_key"), (F.col(order) - F.col("_previous") - 1).alias("gap_length"))


def scale_blocks(df: DataFrame, order: str, scale: str, keys: Sequence[str] = (), capacity: int | None = None, width: int | None = None) -> DataFrame:
    """Adds ``blk``: the number of the stored block, which changes with ``scale`` and after ``capacity`` rows of it."""
    marked = previous(df, order, scale, "_previous", keys, width)
    new = (F.col("_previous").isNotNull() & (F.col("_previous") != F.col(scale))).cast("long")
    numbered = running_sum(marked.withColumn("_new", new), order, "_new", "_part", keys, width).drop("_previous", "_new")
    if capacity is None:
        return numbered.withColumnRenamed("_part", "blk")
    within = offsets(numbered, order, [*keys, "_part"], _width(df, order, keys, width)).withColumn("_sub", F.floor(F.col("offset") / capacity)).drop("offset")
    parts = within.groupBy(*keys, "_part").agg((F.max("_sub") + 1).alias("_n"))
    ends = running_sum(parts, "_part", "_n", "_end", keys).withColumn("_first", F.col("_end") - F.col("_n"))
    return within.join(ends.select(*keys, "_part", "_first"), [*keys, "_part"]).withColumn("blk", F.col("_first") + F.col("_sub")).drop("_part", "_sub", "_first")


def purge(df: DataFrame, offset: int) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): blocks that end before ``offset`` are archived as a whole."""
    ends = df.groupBy("blk").agg(F.max("offset").alias("_end"))
    marked = df.join(ends, "blk")
    return marked.where(F.col("_end") >= offset).drop("_end"), marked.where(F.col("_end") < offset).drop("_end")
