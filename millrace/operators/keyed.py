"""Keyed tables: lookup, grouped counts, ordered and paged selection, versioned changes.

Every function maps DataFrames to DataFrames. Changes are batches applied at
once by joins on the primary key; nothing here iterates over rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.spec import KeySpec, TableSpec


def _ordering(key: KeySpec) -> list[Column]:
    return [F.desc(c) if c in key.descending else F.asc(c) for c in key.order_columns]


def in_group(df: DataFrame, key: KeySpec, group: Sequence[object]) -> DataFrame:
    """Rows whose group columns equal ``group``, nulls included."""
    for name, value in zip(key.group_columns, group, strict=True):
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    return df


def find(df: DataFrame, spec: TableSpec, key_id: int, key: Sequence[object]) -> DataFrame:
    """The row, if any, with that key."""
    for name, value in zip(spec.keys[key_id].columns, key, strict=True):
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    return df.limit(1)


def find_many(df: DataFrame, probes: DataFrame, spec: TableSpec, key_id: int = 0, how: str = "inner") -> DataFrame:
    """``probes`` with the row that has each probe's key."""
    columns = spec.keys[key_id].columns
    left, right = probes.alias("probe"), df.alias("row")
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(f"probe.{c}").eqNullSafe(F.col(f"row.{c}"))
    more = [F.col(f"row.{c}") for c in df.columns if c not in probes.columns]
    return left.join(right, condition, how).select("probe.*", *more)


def group_counts(df: DataFrame, key: KeySpec) -> DataFrame:
    """Rows in each group."""
    return df.groupBy(*key.group_columns).agg(F.count(F.lit(1)).alias("n"))


def after(df: DataFrame, key: KeySpec, position: Sequence[object], inclusive: bool = False) -> DataFrame:
    """Rows that stand after ``position`` in the key's order, compared column by column."""
    beyond: Column = F.lit(inclusive)
    for name, value in reversed(list(zip(key.order_columns, position, strict=True))):
        c, v = F.col(name), F.lit(value)
        # null is the lowest value of a column
        greater = F.when(v.isNull(), c.isNotNull()).otherwise(F.coalesce(c > v, F.lit(False)))
        less = F.when(c.isNull(), v.isNotNull()).otherwise(F.coalesce(c < v, F.lit(False)))
        beyond = (less if name in key.descending else greater) | (c.eqNullSafe(v) & beyond)
    return df.where(beyond)


def select_rows(
    df: DataFrame, key: KeySpec, group: Sequence[object] = (), limit: int | None = None, position: Sequence[object] | None = None, inclusive: bool = False
) -> DataFrame:
    """Rows of a group in the key's order, at most ``limit``, from ``position`` on."""
    found = in_group(df, key, group)
    if position is not None:
        found = after(found, key, position, inclusive)
    order = _ordering(key)
    found = found.orderBy(*order) if order else found
    return found if limit is None else found.limit(limit)


def select_keys(df: DataFrame, key: KeySpec, *args, **kwargs) -> DataFrame:
    """As ``select_rows``, the key's columns alone."""
    return select_rows(df, key, *args, **kwargs).select(*key.columns)


def top_per_group(df: DataFrame, key: KeySpec, n: int = 1) -> DataFrame:
    """The first ``n`` rows of every group, with their place.

    With one row wanted and one ordering column it is an aggregate, so each task
    sends one row of a group.
    """
    if n == 1 and len(key.order_columns) == 1:
        row = F.struct(F.col(key.order_columns[0]), F.struct(*df.columns).alias("_row"))
        best = F.max(row) if key.descending else F.min(row)
        return df.groupBy(*key.group_columns).agg(best.alias("_best")).select("_best._row.*").withColumn("place", F.lit(1))
    numbered = df.withColumn("place", F.row_number().over(Window.partitionBy(*key.group_columns).orderBy(*_ordering(key))))
    return numbered.where(F.col("place") <= n)


def with_result_count(df: DataFrame, key: KeySpec) -> DataFrame:
    """Rows with the number of rows of their group up to and with them."""
    return df.withColumn("count_so_far", F.row_number().over(Window.partitionBy(*key.group_columns).orderBy(*_ordering(key))))


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Missing columns and nulls replaced by the columns' defaults."""
    return df.select(
        *[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in df.columns],
        *[F.lit(v).alias(c) for c, v in defaults.items() if c not in df.columns],
    )


# -- changes


def insert(table: DataFrame, new: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """(table with the new rows, rejected rows): a row whose primary key exists, or came before, is rejected."""
    keys = list(spec.primary)
    first = Window.partitionBy(*keys).orderBy("_un")
    numbered = new.withColumn("_nth", F.row_number().over(first))
    known = table.select(*keys).distinct().withColumn("_known", F.lit(True))
    marked = numbered.join(known, keys, "left")
    good = marked.where(F.col("_known").isNull() & (F.col("_nth") == 1)).drop("_known", "_nth").withColumn("_vn", F.lit(0).cast("long"))
    bad = marked.where(F.col("_known").isNotNull() | (F.col("_nth") > 1)).drop("_known", "_nth")
    return table.unionByName(good.select(*table.columns)), bad


def update(table: DataFrame, changes: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """(table with mutable columns changed, changes of rows that don't exist).

    Of several changes of a row the last by ``_un`` that sets a column counts. A
    null in a change leaves the column as it is; a column named in ``_reset``
    becomes null.
    """
    keys, mutable = list(spec.primary), [c for c in spec.mutable if c in changes.columns]
    reset = F.col("_reset") if "_reset" in changes.columns else F.array().cast("array<string>")
    marks = changes.withColumn("_reset", F.coalesce(reset, F.array().cast("array<string>")))
    value = lambda c: F.when(F.array_contains("_reset", c), F.struct(F.lit(True).alias("set"), F.lit(None).cast(changes.schema[c].dataType).alias("v"))).when(F.col(c).isNotNull(), F.struct(F.lit(True).alias("set"), F.col(c).alias("v")))
    last = marks.groupBy(*keys).agg(
        *[F.max_by(value(c), F.when(value(c).isNotNull(), F.col("_un"))).alias(f"_new_{c}") for c in mutable], F.max("_un").alias("_new_un"), F.count(F.lit(1)).alias("_changes")
    )
    joined = table.join(last, keys, "left")
    changed = joined.select(
        *[
            F.when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}.v")).otherwise(F.col(c)).alias(c) if c in mutable
            else F.coalesce("_new_un", "_un").alias(c) if c == "_un"
            else (F.col("_vn") + F.coalesce("_changes", F.lit(0))).alias(c) if c == "_vn"
            else F.col(c)
            for c in table.columns
        ]
    )
    return changed, changes.join(table.select(*keys), keys, "left_anti")


def delete(table: DataFrame, gone: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """(table without the rows whose primary key is in ``gone``, their tombstones with version -vn - 1)."""
    keys = list(spec.primary)
    last = gone.groupBy(*keys).agg(F.max("_un").alias("_gone_un"))
    tombs = table.join(last, keys).withColumn("_un", F.col("_gone_un")).withColumn("_vn", -F.col("_vn") - 1).select(*table.columns)
    return table.join(last, keys, "left_anti"), tombs


def fold_changes(changes: DataFrame, keys: Sequence[str], order: str = "_un", op: str = "op", deleted: str = "delete", aborted: str = "abort") -> DataFrame:
    """The rows that a change stream leaves: each key's last change, unless it deletes; aborted changes never were."""
    live = changes.where(~F.col(op).eqNullSafe(aborted))
    row = F.struct(*[c for c in changes.columns if c not in keys])
    return live.groupBy(*keys).agg(F.max_by(row, F.col(order)).alias("_row"), F.count(F.lit(1)).alias("changes")).select(*keys, "_row.*", "changes").where(~F.col(op).eqNullSafe(deleted))


def apply_once(changes: DataFrame, applied: DataFrame, shard: str = "_shard", number: str = "_un") -> DataFrame:
    """Changes that a replay hasn't applied yet: those whose number is over their shard's highest in ``applied``."""
    highest = applied.groupBy(shard).agg(F.max(number).alias("_highest"))
    return changes.join(highest, shard, "left").where(F.col("_highest").isNull() | (F.col(number) > F.col("_highest"))).drop("_highest")


def last_numbers(table: DataFrame) -> DataFrame:
    """Each shard's highest update number and the sequence number that came with it."""
    return table.groupBy("_shard").agg(F.max("_un").alias("max_un"), F.max_by("_sn", "_un").alias("max_sn"))
