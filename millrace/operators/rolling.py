"""Rolling and whole-series statistics, order statistics, and sliding windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing(order: Sequence[str], rows: int, keys: Sequence[str] = ()):
    """The window of a row and the ``rows - 1`` before it."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)


def moments(value: Column, exact: bool, over=None) -> dict[str, Column]:
    """Total, mean and population variance; from whole sums, so free of rounding before the last division, if ``exact``."""
    on = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    n = on(F.count(value))
    if not exact:
        return {"total": on(F.sum(value)), "mean": on(F.avg(value)), "var": on(F.var_pop(value))}
    whole = value.cast("decimal(18,0)")
    total, squares = on(F.sum(whole)), on(F.sum(whole * whole))
    spread = n.cast("decimal(10,0)") * squares.cast("decimal(28,0)") - total.cast("decimal(19,0)") * total.cast("decimal(19,0)")
    return {"total": total.cast("double"), "mean": total.cast("double") / n, "var": spread.cast("double") / (n * n)}


def _is_whole(df: DataFrame, value: str) -> bool:
    return df.schema[value].dataType.typeName() in ("byte", "short", "integer", "long")


def rolling_stats(df: DataFrame, value: str, order: Sequence[str], rows: int, keys: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Adds n, total, mean, var, std (of the population), low and high of the trailing rows; nought for no values.

    Fixed-point values, as whole mantissas, give exact sums.
    """
    w = trailing(order, rows, keys)
    shown = lambda c: F.round(F.coalesce(c, F.lit(0.0)), digits) if digits is not None else F.coalesce(c, F.lit(0.0))
    m = moments(F.col(value), _is_whole(df, value), w)
    found = df.select("*", F.count(value).over(w).alias("n"), *[c.alias(f"_{k}") for k, c in m.items()], F.min(value).over(w).alias("_low"), F.max(value).over(w).alias("_high"))
    nan = F.lit(float("nan"))
    return found.select(
        *df.columns, "n", shown(F.col("_total")).alias("total"), shown(F.col("_mean")).alias("mean"), shown(F.col("_var")).alias("var"), shown(F.sqrt("_var")).alias("std"),
        F.coalesce(F.col("_low").cast("double"), nan).alias("low"), F.coalesce(F.col("_high").cast("double"), nan).alias("high"),
    )


def at_rank(values: Column, p: float) -> Column:
    """The value at the 0-based place floor(p * count) of the sorted ``values``, NaN if there are none."""
    return F.coalesce(F.try_element_at(F.sort_array(values), (F.floor(F.size(values) * F.lit(p)) + 1).cast("int")), F.lit(float("nan")))


def rolling_ranks(df: DataFrame, value: str, order: Sequence[str], rows: int, ranks: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Adds exact order statistics of the trailing rows; the median (0.5) is the upper one."""
    held = df.withColumn("_values", F.collect_list(value).over(trailing(order, rows, keys)))
    return held.select("*", *[at_rank(F.col("_values"), p).alias(name) for name, p in ranks.items()]).drop("_values")


def stats(df: DataFrame, value: str, keys: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """n, total, mean, var, std, low and high of each group."""
    shown = lambda c: F.round(c, digits) if digits is not None else c
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        shown(F.coalesce(F.sum(value), F.lit(0.0))).alias("total"),
        shown(F.coalesce(F.avg(value), F.lit(0.0))).alias("mean"),
        shown(F.coalesce(F.var_pop(value), F.lit(0.0))).alias("var"),
        shown(F.coalesce(F.stddev_pop(value), F.lit(0.0))).alias("std"),
        F.coalesce(F.min(value), F.lit(float("nan"))).alias("low"),
        F.coalesce(F.max(value), F.lit(float("nan"))).alias("high"),
    )


def histogram(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """How often each value occurs."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def _beside(rows: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows with what ``facts`` says of their keys, which may be null; without keys it is one row."""
    if not keys:
        return rows.crossJoin(F.broadcast(facts))
    named = facts.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    return rows.join(named, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]).drop(*[f"_key_{k}" for k in keys])


def ranks(df: DataFrame, value: str, at: dict[str, float], keys: Sequence[str] = (), parts: int = 32) -> DataFrame:
    """Exact order statistics of each group at floor(p * count).

    They are read off the running counts of the groups' histograms. A group's
    values are cut into ``parts`` at quantiles of about 1000 of them, chosen by
    their hashes, which says only where a part ends; the counts run within a part
    and over the parts, so no task holds all values of a group. Two branches
    meet the cuts, so these must not vary with the order of rows, as those of an
    approximate percentile do.
    """
    counts = histogram(df, value, keys)
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("_size"), F.count(F.lit(1)).alias("_distinct"))
    chosen = F.when(F.pmod(F.xxhash64(value), F.greatest(F.lit(1).cast("long"), F.expr("_distinct div 1000"))) == 0, F.col(value))
    sample = _beside(counts, sizes, keys).groupBy(*keys, "_size").agg(F.sort_array(F.collect_list(chosen)).alias("_s"))
    ends = F.array(*[F.try_element_at("_s", (F.floor(F.size("_s") * i / parts) + 1).cast("int")) for i in range(1, parts)])
    cuts = sample.select(*keys, "_size", ends.alias("_cuts"))
    cut = _beside(counts, cuts, keys).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    upto = F.sum("n").over(Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    places = {name: F.floor(F.col("_size") * F.lit(p)) for name, p in at.items()}
    runs = cut.withColumn("_upto", upto)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = cut.groupBy(*keys, "_part").agg(F.sum("n").alias("_n")).withColumn("_before", before).drop("_n")
    summed = _beside(runs, totals, [*keys, "_part"]).withColumn("_upto", F.col("_upto") + F.col("_before"))
    return summed.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") > place, F.col(value))).alias(name) for name, place in places.items()])


def count_below(df: DataFrame, value: str, probe: Column, keys: Sequence[str] = ()) -> DataFrame:
    """How many values of each group are less than ``probe``."""
    return df.groupBy(*keys).agg(F.count_if(F.col(value) < probe).alias("below"))


def intervals(df: DataFrame, begin: str, end: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, shortest, longest, total and mean of the durations end - begin; noughts where there are none.

    The total is DECIMAL(38, 0), as that of many microseconds exceeds BIGINT.
    """
    took = F.col(end) - F.col(begin)
    nought = lambda c: F.coalesce(c, F.lit(0))
    total = F.sum(took.cast("decimal(19,0)")).cast("decimal(38,0)")
    mean = F.coalesce(total.cast("double") / F.nullif(F.count(took), F.lit(0).cast("long")), F.lit(0.0))
    return df.groupBy(*keys).agg(F.count(took).alias("n"), nought(F.min(took)).alias("shortest"), nought(F.max(took)).alias("longest"), nought(total).alias("total"), mean.alias("mean"))


def value_window(df: DataFrame, at: str, value: str, length: int, interval: int, keys: Sequence[str] = (), late: str | None = None) -> DataFrame:
    """Adds window_total and window_mean over the ``length`` buckets of width ``interval`` that end with each row's.

    The mean is over the window's width, not its rows. Values of a bucket meet
    before the window, so the window is over buckets. With ``late``, the order
    of arrival, a row older than the whole window of its time is left out.
    """
    cut = df.withColumn("bucket", F.floor(F.col(at) / interval))
    if late is not None:
        head = F.max("bucket").over(Window.partitionBy(*keys).orderBy(late).rowsBetween(Window.unboundedPreceding, 0))
        cut = cut.withColumn("_head", head).where(F.col("bucket") > F.col("_head") - length).drop("_head")
    sums = cut.groupBy(*keys, "bucket").agg(F.sum(value).alias("bucket_total"))
    w = Window.partitionBy(*keys).orderBy("bucket").rangeBetween(1 - length, 0)
    total = F.sum("bucket_total").over(w)
    return sums.select(*keys, "bucket", "bucket_total", total.alias("window_total"), (total / (length * interval)).alias("window_mean"))


def last_slots(df: DataFrame, index: str, size: int, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """The last write to each of the highest ``size`` indices."""
    last = df.groupBy(*keys, index).agg(F.max_by(F.struct(*[c for c in df.columns if c not in (*keys, index)]), order).alias("_row"))
    highest = last.groupBy(*keys).agg(F.max(index).alias("_highest"))
    joined = last.join(highest, list(keys)) if keys else last.crossJoin(F.broadcast(highest))  # one row
    return joined.where(F.col(index) > F.col("_highest") - size).select(*keys, index, "_row.*")


def bit_window(df: DataFrame, index: str, value: str, bits: int, size: int, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """The last write to each of the highest ``size`` indices as a field of ``bits`` bits, and whether all bits of all fields are set."""
    top = (1 << bits) - 1
    fields = last_slots(df.select(*keys, index, F.col(value).bitwiseAND(F.lit(top)).alias(value), order), index, size, order, keys).drop(order)
    whole = fields.groupBy(*keys).agg((F.count(F.lit(1)) == size).alias("_full"), F.bit_and(value).alias("_and"))
    marked = fields.join(whole, list(keys)) if keys else fields.crossJoin(F.broadcast(whole))  # one row
    return marked.withColumn("all_set", F.col("_full") & (F.col("_and") == top)).drop("_full", "_and")
