"""Array fields, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def show(values: Column) -> Column:
    """[a, b, ...]; a null element prints as nothing."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: F.coalesce(x.cast("string"), F.lit(""))), ", "), F.lit("]"))


def element(values: Column, i: Column) -> Column:
    """The element at the 0-based place, null outside."""
    return F.when(i >= 0, F.try_element_at(values, (i + 1).cast("int")))


def splice(values: Column, at: int, length: int, new: Column) -> Column:
    """``length`` elements from the 0-based place ``at`` replaced."""
    return F.concat(F.slice(values, 1, at), new, F.slice(values, F.lit(at + length + 1), F.greatest(F.size(values), F.lit(1))))


def search(values: Column, value: Column) -> Column:
    """The 0-based place of the first such element, -1 if there is none."""
    return F.array_position(values, value) - 1
