"""Where the library's queries over the test tables are registered, each with its SQL if there is one."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_own_root: list[str] = []


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; where none is set, a temporary one in local mode alone."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_root:
            _own_root.append(tempfile.mkdtemp(prefix="millrace-"))
        root = _own_root[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
