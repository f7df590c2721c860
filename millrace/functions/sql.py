"""The functions that SQL lacks, under names that ``spark.sql`` can call."""

from __future__ import annotations

from pyspark.sql import SparkSession

from millrace.functions import decimals, texts

FUNCTIONS = {
    "decimal_multiply": decimals._product,
    "decimal_divide": decimals._quotient,
    "base32": texts.base32,
    "unbase32": texts.unbase32,
    "display_width": texts.width,
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session; decimals are taken as DECIMAL(36, 18)."""
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
