"""Reading and writing tables: Parquet, memory, JDBC, header-mapped CSV, captures, alerts, snapshots."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping, Sequence
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.spec import TableSpec

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


class Store(Protocol):
    """Where tables live: what a connector offers."""

    def read(self, spec: TableSpec) -> DataFrame: ...

    def write(self, spec: TableSpec, df: DataFrame, mode: str = "append") -> None: ...


class ParquetStore:
    """Tables as Parquet folders under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, spec: TableSpec) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{spec.name}")

    def write(self, spec: TableSpec, df: DataFrame, mode: str = "append") -> None:
        df.write.mode(mode).parquet(f"{self.path}/{spec.name}")


class MemoryStore:
    """Tables held by the session, for tests."""

    def __init__(self):
        self.tables: dict[str, DataFrame] = {}

    def read(self, spec: TableSpec) -> DataFrame:
        return self.tables[spec.name]

    def write(self, spec: TableSpec, df: DataFrame, mode: str = "append") -> None:
        old = self.tables.get(spec.name) if mode == "append" else None
        self.tables[spec.name] = df if old is None else old.unionByName(df)


class JdbcStore:
    """Tables of a database; ``options`` holds url, user, driver and, for parallel reads, partitionColumn and its bounds."""

    def __init__(self, spark: SparkSession, **options: str):
        self.spark, self.options = spark, options

    def read(self, spec: TableSpec) -> DataFrame:
        return self.spark.read.format("jdbc").options(dbtable=spec.name, **self.options).load()

    def write(self, spec: TableSpec, df: DataFrame, mode: str = "append") -> None:
        df.write.format("jdbc").options(dbtable=spec.name, **self.options).mode(mode).save()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def create(spark: SparkSession, spec: TableSpec, schema: StructType, cluster: bool = True) -> None:
    """A table in the catalog; its primary key's columns are bucketed and sorted, so joins on it need no shuffle."""
    writer = spark.createDataFrame([], schema).write.format("parquet").mode("ignore")
    if cluster:
        writer = writer.bucketBy(64, *spec.primary).sortBy(*spec.primary)
    writer.saveAsTable(spec.name)


# -- CSV, mapped by the header's names


def read_csv(spark: SparkSession, path: str, schema: StructType, defaults: Mapping[str, object] | None = None, parsers: Mapping[str, object] | None = None) -> DataFrame:
    """Columns of ``schema`` by the header's names: others are ignored, missing and empty ones get their default.

    ``parsers`` has functions from a text Column for kinds that a cast can't
    read. Rows without any value are left out.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, multiLine=False)
    defaults, parsers = defaults or {}, parsers or {}

    def column(f) -> Column:
        value = F.lit(None).cast("string") if f.name not in raw.columns else F.col(f"`{f.name}`")
        read = parsers[f.name](value) if f.name in parsers else value.try_cast(f.dataType)
        return F.coalesce(read, F.lit(defaults[f.name])).alias(f.name) if f.name in defaults else read.alias(f.name)

    some = F.coalesce(*[F.col(f"`{c}`") for c in raw.columns]).isNotNull()
    return raw.where(some).select(*[column(f) for f in schema.fields])


def write_csv(df: DataFrame, path: str, columns: Sequence[str] = ()) -> None:
    """The listed columns in their order, all for none or ``*``; quotes are doubled."""
    chosen = df if not columns or list(columns) == ["*"] else df.select(*columns)
    chosen.write.csv(path, header=True, quote='"', escape='"', quoteAll=False)


# -- binary captures


#: Layouts of records in captures, as of struct, with the names of the fields before each body. ``len``
#: is the body's length. An event file begins with a header of 20 bytes that starts with the magic number.
DATAGRAM = ("<HHqI", ("len", "group", "sec", "nsec"))
EVENT = ("<QIHBB", ("seq_no", "nsec", "len", "type", "shard"))
EVENT_HEADER, EVENT_MAGIC = 20, 0xC0DEF17E


def read_records(spark: SparkSession, path: str, layout: tuple[str, tuple[str, ...]] = DATAGRAM, skip: int = 0, magic: int | None = None) -> DataFrame:
    """Records of capture files: the layout's fields, the body, the file and the record's number in it.

    ``skip`` bytes at the start of a file are its header; with ``magic`` a file
    that doesn't begin with that number has no records. A file is read by one
    task and must fit a row (2 GB); a record that is cut off at the end is left
    out.
    """
    form, fields = layout
    size = struct.calcsize(form)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows, at, n = [], skip, 0
                if magic is not None and content[:4] != struct.pack("<I", magic):
                    continue
                while at + size <= len(content):
                    head = dict(zip(fields, struct.unpack_from(form, content, at), strict=True))
                    if at + size + head["len"] > len(content):
                        break
                    rows.append((*head.values(), content[at + size : at + size + head["len"]], name, n))
                    at, n = at + size + head["len"], n + 1
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=[*fields, "body", "file", "number"])
                        rows = []
                yield pd.DataFrame(rows, columns=[*fields, "body", "file", "number"])

    schema = ", ".join(f"`{f}` long" for f in fields) + ", body binary, file string, number long"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def replay(spark: SparkSession, path: str, at: str, begin: object = None, end: object = None) -> DataFrame:
    """A recorded event table from ``begin`` up to, without, ``end``, in order; the bounds reach the scan."""
    found = spark.read.parquet(path)
    if begin is not None:
        found = found.where(F.col(at) >= F.lit(begin))
    if end is not None:
        found = found.where(F.col(at) < F.lit(end))
    return found.orderBy(at)


# -- telemetry and alerts


def named(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows by name: none or a leading * for all, a trailing * for a prefix, else the very name."""
    if not pattern or pattern.startswith("*"):
        return df
    return df.where(F.col(column).startswith(pattern[:-1]) if pattern.endswith("*") else F.col(column) == pattern)


def latest(snapshots: DataFrame, keys: Sequence[str], at: str = "snapshot_ts") -> DataFrame:
    """Each object's last snapshot."""
    rest = [c for c in snapshots.columns if c not in keys]
    return snapshots.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_x")).select(*keys, "_x.*")


def write_alerts(alerts: DataFrame, path: str, at: str = "ts") -> None:
    """Appends alerts by day, numbered within each from 0 or on from the day's last number in ``path``."""
    spark, numbered = alerts.sparkSession, numbered_by_day(alerts, at)
    days = [r[0] for r in numbered.select("yyyymmdd").distinct().collect()]  # as many as the days of a batch
    try:
        old = spark.read.parquet(path).where(F.col("yyyymmdd").isin(days)).groupBy("yyyymmdd").agg((F.max("seq_no") + 1).alias("_next"))
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    else:
        numbered = numbered.join(old, "yyyymmdd", "left").withColumn("seq_no", F.col("seq_no") + F.coalesce("_next", F.lit(0))).drop("_next")
    numbered.write.mode("append").partitionBy("yyyymmdd").parquet(path)


def numbered_by_day(alerts: DataFrame, at: str = "ts") -> DataFrame:
    """``alerts`` with yyyymmdd and seq_no, from 0 within each day; a day is numbered hour by hour, so no task sees all of it."""
    rest = [c for c in alerts.columns if c != at]
    day = alerts.withColumns({"yyyymmdd": F.date_format(at, "yyyyMMdd").cast("int"), "_hour": F.hour(at)})
    before = F.sum("_n").over(Window.partitionBy("yyyymmdd").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1))
    hours = day.groupBy("yyyymmdd", "_hour").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("yyyymmdd", "_hour").orderBy(at, *rest)) - 1
    return day.withColumn("seq_no", own).join(hours, ["yyyymmdd", "_hour"]).withColumn("seq_no", (F.col("seq_no") + F.col("_before")).cast("int")).drop("_hour", "_before")


def recent_alerts(spark: SparkSession, path: str, day: int) -> DataFrame:
    """Alerts from a day on; older partitions aren't read."""
    return spark.read.parquet(path).where(F.col("yyyymmdd") >= day)


def fan_out(events: DataFrame, sinks: Mapping[str, Column], columns: Mapping[str, Sequence[str]] | None = None) -> dict[str, DataFrame]:
    """One DataFrame per sink: the events of its kind, in its columns."""
    columns = columns or {}
    return {name: events.where(kind).select(*columns.get(name, events.columns)) for name, kind in sinks.items()}
