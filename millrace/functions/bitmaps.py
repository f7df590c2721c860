"""Bitmaps as sorted arrays of set bits with a capacity, as Columns.

A bitmap is struct<bits: array<int>, size: int>; its size is a multiple of 64.
Text such as ``0-1,3,8-`` lists bits and ranges; an open range goes to the end
of the capacity.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIND = "struct<bits:array<int>,size:int>"


def _words(n: Column) -> Column:
    return (F.ceil(n / 64) * 64).cast("int")


def _sorted(bits: Column) -> Column:
    return F.array_sort(F.array_distinct(bits))


def of(bits: Column, size: Column | None = None) -> Column:
    """A bitmap of an array of bits, with at least ``size`` places."""
    top = F.coalesce(F.array_max(bits) + 1, F.lit(0))
    return F.struct(_sorted(bits).alias("bits"), _words(F.greatest(top, size) if size is not None else top).alias("size"))


def parse(text: Column) -> Column:
    """Text as a bitmap; null for text that is no list of bits and ranges."""
    ok = text.rlike(r"^\s*(([0-9]+(-[0-9]*)?)?(,|$))*\s*$")
    parts = F.filter(F.split(F.trim(text), ","), lambda p: p != "")
    begin = lambda p: F.regexp_extract(p, r"^([0-9]+)", 1).cast("int")
    end = lambda p: F.regexp_extract(p, r"-([0-9]+)$", 1).try_cast("int")
    top = F.array_max(F.transform(parts, lambda p: F.greatest(begin(p), F.coalesce(end(p), begin(p)))))
    size = F.coalesce(_words(top + 1), F.lit(0))
    until = lambda p: F.when(p.endswith("-"), size - 1).otherwise(F.coalesce(end(p), begin(p)))
    bits = F.flatten(F.transform(parts, lambda p: F.when(until(p) >= begin(p), F.sequence(begin(p), until(p))).otherwise(F.array().cast("array<int>"))))
    return F.when(ok, F.struct(_sorted(bits).alias("bits"), size.alias("size")))


def text(bitmap: Column) -> Column:
    """The bitmap's ranges; one that reaches the end of the capacity is open."""
    bits, size = bitmap["bits"], bitmap["size"]
    begins = F.filter(bits, lambda b: ~F.array_contains(bits, b - 1))
    ends = F.filter(bits, lambda b: ~F.array_contains(bits, b + 1))
    one = lambda b, e: F.when(e == size - 1, F.concat(b.cast("string"), F.lit("-"))).when(b == e, b.cast("string")).otherwise(F.concat_ws("-", b.cast("string"), e.cast("string")))
    return F.array_join(F.zip_with(begins, ends, one), ",")


def length(bitmap: Column) -> Column:
    return bitmap["size"]


def get(bitmap: Column, i: Column) -> Column:
    return F.array_contains(bitmap["bits"], i)


def set_range(bitmap: Column, begin: Column, end: Column) -> Column:
    """The bits from ``begin`` up to, without, ``end`` set; the capacity grows."""
    more = F.when(end > begin, F.sequence(begin, end - 1)).otherwise(F.array().cast("array<int>"))
    return of(F.concat(bitmap["bits"], more), F.greatest(bitmap["size"], end))


def clear_range(bitmap: Column, begin: Column, end: Column) -> Column:
    return F.struct(F.filter(bitmap["bits"], lambda b: (b < begin) | (b >= end)).alias("bits"), bitmap["size"].alias("size"))


def first(bitmap: Column) -> Column:
    return F.coalesce(F.array_min(bitmap["bits"]), F.lit(-1))


def last(bitmap: Column) -> Column:
    return F.coalesce(F.array_max(bitmap["bits"]), F.lit(-1))


def following(bitmap: Column, i: Column) -> Column:
    """The first set bit after ``i``, or -1."""
    return F.coalesce(F.array_min(F.filter(bitmap["bits"], lambda b: b > i)), F.lit(-1))


def preceding(bitmap: Column, i: Column) -> Column:
    """The last set bit before ``i``, or -1."""
    return F.coalesce(F.array_max(F.filter(bitmap["bits"], lambda b: b < i)), F.lit(-1))


def _grown(a: Column, b: Column) -> Column:
    return F.greatest(a["size"], b["size"])


def union(a: Column, b: Column) -> Column:
    return F.struct(_sorted(F.array_union(a["bits"], b["bits"])).alias("bits"), _grown(a, b).alias("size"))


def intersection(a: Column, b: Column) -> Column:
    return F.struct(_sorted(F.array_intersect(a["bits"], b["bits"])).alias("bits"), _grown(a, b).alias("size"))


def difference(a: Column, b: Column) -> Column:
    """Bits of one of the two."""
    either = F.concat(F.array_except(a["bits"], b["bits"]), F.array_except(b["bits"], a["bits"]))
    return F.struct(_sorted(either).alias("bits"), _grown(a, b).alias("size"))


def flip(a: Column) -> Column:
    every = F.when(a["size"] > 0, F.sequence(F.lit(0), a["size"] - 1)).otherwise(F.array().cast("array<int>"))
    return F.struct(F.array_except(every, a["bits"]).alias("bits"), a["size"].alias("size"))


def send(bitmap: Column) -> Column:
    """The count of 64-bit words and the words, in hex with the highest byte first."""
    n = (bitmap["size"] / 64).cast("int")
    word = lambda w: F.lpad(F.hex(F.aggregate(F.filter(bitmap["bits"], lambda b: F.floor(b / 64) == w), F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(b, F.lit(64)).cast("int"))))), 16, "0")
    words = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), word)).otherwise(F.array().cast("array<string>"))
    return F.lower(F.concat(F.lpad(F.hex(n), 8, "0"), F.array_join(words, "")))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the highest bit that one of the two has alone."""
    top = last(difference(a, b))
    return F.when(top < 0, 0).when(get(a, top), 1).otherwise(-1)
