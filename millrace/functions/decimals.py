"""Decimals with 18 digits after the point and fixed-point numbers, as Columns.

A decimal is DECIMAL(36, 18). Sums and differences are Spark's own. A product has
more digits than Spark's widest decimal, so it is made of the products of the
whole and the broken parts, as is a quotient by a whole number; a quotient by any
other decimal runs on Python integers in Arrow batches.
"""

from __future__ import annotations

from decimal import ROUND_DOWN, Context, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DecimalType

KIND = "decimal(36,18)"
_WIDE = Context(prec=110, rounding=ROUND_DOWN)
_STEP, _SHIFT = Decimal(1).scaleb(-18), Decimal(10) ** 18


def _minus(value: Column) -> Column:
    """-value; Spark's own sign change and abs keep 34 digits alone."""
    return (F.lit(Decimal(0)).cast("decimal(1,0)") - value.cast(KIND)).cast(KIND)


def _abs(value: Column) -> Column:
    return F.when(value < 0, _minus(value)).otherwise(value.cast(KIND))


def parse(text: Column) -> Column:
    """Text as a decimal: digits after the 18th are cut off; nan, junk and over 18 digits before the point give null."""
    body = F.regexp_extract(F.rtrim(text), r"^([+-]?)0*([0-9]*)(?:\.([0-9]{0,18})[0-9]*)?$", 0)
    sign, whole, part = (F.regexp_extract(F.rtrim(text), r"^([+-]?)0*([0-9]*)(?:\.([0-9]{0,18})[0-9]*)?$", i) for i in (1, 2, 3))
    has_digit = F.rtrim(text).rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$")
    plain = F.concat(sign, F.when(whole == "", "0").otherwise(whole), F.lit("."), F.when(part == "", "0").otherwise(part))
    return F.when(has_digit & (body != "") & (F.length(whole) <= 18), plain.try_cast(KIND))


def text(value: Column) -> Column:
    """A decimal without needless zeros; null prints as NaN."""
    return F.coalesce(F.call_function("format_number", value.cast(KIND), F.lit("0.##################")), F.lit("NaN"))


def grouped(value: Column, ndp: int) -> Column:
    """A decimal cut to ``ndp`` places, with commas between thousands."""
    return F.format_number(truncate(value, ndp), ndp)


def truncate(value: Column, ndp: int) -> Column:
    """The decimal without its digits after the ``ndp``-th."""
    if ndp >= 18:
        return value.cast(KIND)
    scaled = F.round(_abs(value), ndp)
    over = scaled > _abs(value)
    down = F.when(over, scaled - F.lit(Decimal(1).scaleb(-ndp)).cast(KIND)).otherwise(scaled)
    return F.when(value < 0, _minus(down)).otherwise(down.cast(KIND))


def add(a: Column, b: Column, strict: bool = False) -> Column:
    """a + b; out of range is null, or an error if ``strict``."""
    total = a.cast(KIND) + b.cast(KIND)
    return total.cast(KIND) if strict else total.try_cast(KIND)


def subtract(a: Column, b: Column, strict: bool = False) -> Column:
    """a - b, as ``add``."""
    total = a.cast(KIND) - b.cast(KIND)
    return total.cast(KIND) if strict else total.try_cast(KIND)


def _cut(x: Decimal | None) -> Decimal | None:
    if x is None:
        return None
    x = x.quantize(_STEP, context=_WIDE)
    return x if abs(x) < _SHIFT else None


def _limbs(value: Column) -> tuple[Column, Column]:
    """The whole part and the broken part's 18 digits, both whole and without sign."""
    size = _abs(value)
    whole = F.floor(size).cast("decimal(18,0)")
    broken = (size - whole).cast("decimal(18,18)") * F.lit(_SHIFT).cast("decimal(19,0)")
    return whole, broken.cast("decimal(18,0)")


def _of_limbs(sign: Column, whole: Column, broken: Column) -> Column:
    """The decimal of a whole part and of 18 digits of its broken part."""
    size = whole.cast("decimal(18,0)").cast(KIND) + broken.cast("decimal(18,0)") * F.lit(_STEP).cast("decimal(18,18)")
    size = size.try_cast(KIND)
    return F.when(sign < 0, _minus(size)).otherwise(size)


def _over(value: Column) -> Column:
    """The whole number divided by 10 ** 18."""
    return F.call_function("div", value, F.lit(_SHIFT).cast("decimal(19,0)"))


@pandas_udf(DecimalType(36, 18))
def _product(a: pd.Series, b: pd.Series) -> pd.Series:
    """``multiply`` under a name that SQL text can call."""
    return pd.Series([None if x is None or y is None else _cut(_WIDE.multiply(x, y)) for x, y in zip(a, b, strict=True)], dtype=object)


@pandas_udf(DecimalType(36, 18))
def _quotient(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None or y == 0 else _cut(_WIDE.divide(x, y)) for x, y in zip(a, b, strict=True)], dtype=object)


def multiply(a: Column, b: Column) -> Column:
    """a * b cut to 18 places; out of range is null."""
    (a1, a0), (b1, b0) = _limbs(a), _limbs(b)
    mantissa = (a1 * b0).cast("decimal(38,0)") + (a0 * b1).cast("decimal(38,0)") + _over(a0 * b0)
    carry, top = _over(mantissa.cast("decimal(38,0)")), (a1 * b1).cast("decimal(37,0)")
    whole = top + carry.cast("decimal(19,0)")
    broken = mantissa.cast("decimal(38,0)") - carry.cast("decimal(19,0)") * F.lit(_SHIFT).cast("decimal(19,0)")
    fits = whole < F.lit(_SHIFT).cast("decimal(19,0)")
    return F.when(fits, _of_limbs(F.signum(a.cast(KIND)) * F.signum(b.cast(KIND)), F.when(fits, whole), broken))


def divide(a: Column, b: Column) -> Column:
    """a / b cut to 18 places; by nought, or out of range, is null."""
    return _quotient(a.cast(KIND), b.cast(KIND))


def divide_whole(a: Column, n: Column) -> Column:
    """a / n cut to 18 places for a whole number n, which is BIGINT; by nought is null."""
    a1, a0 = _limbs(a)
    by = F.nullif(F.abs(n.cast("decimal(19,0)")), F.lit(0).cast("decimal(19,0)"))
    whole = F.call_function("div", a1, by).cast("decimal(19,0)")
    left = a1 - whole * by
    digits = left.cast("decimal(19,0)") * F.lit(_SHIFT).cast("decimal(19,0)") + a0
    return _of_limbs(F.signum(a.cast(KIND)) * F.signum(n), whole, F.call_function("div", digits.cast("decimal(38,0)"), by))


def floor(value: Column) -> Column:
    """The whole part, toward nought."""
    return truncate(value, 0)


def round_half_up(value: Column, ndp: int = 0) -> Column:
    """Rounded half away from nought."""
    return F.round(value.cast(KIND), ndp).cast(KIND)


def frac(value: Column) -> Column:
    """What comes after the point, with the sign."""
    return (value.cast(KIND) - truncate(value, 0)).cast(KIND)


def places(value: Column) -> Column:
    """How many places after the point are used."""
    return F.length(F.regexp_extract(text(value), r"\.([0-9]+)$", 1))


def smaller(a: Column, b: Column) -> Column:
    """The smaller; null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def larger(a: Column, b: Column) -> Column:
    """The larger; null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null is the lowest and equals itself."""
    return F.when(a.eqNullSafe(b), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).otherwise(1)


def total(value: Column) -> Column:
    """The sum over rows; null for none or out of range."""
    return F.try_sum(value.cast(KIND)).try_cast(KIND)


def mean(value: Column) -> Column:
    """The mean over rows cut to 18 places; null for none."""
    return divide_whole(F.sum(value.cast(KIND)).try_cast(KIND), F.count(value))


# -- fixed point: a whole mantissa and its number of places


def rescale(mantissa: Column, ndp: int, to: int) -> Column:
    """The mantissa at ``to`` places; fewer places cut digits off."""
    if to >= ndp:
        return (mantissa * F.lit(10 ** (to - ndp))).cast("bigint")
    return F.call_function("div", mantissa, F.lit(10 ** (ndp - to)).cast("bigint"))


def fixed_multiply(m1: Column, m2: Column, ndp2: int) -> Column:
    """The product at the first one's places, cut; null from 10**15 whole digits' worth on."""
    product = m1.cast("decimal(19,0)") * m2.cast("decimal(19,0)")
    step = F.lit(Decimal(10) ** ndp2).cast("decimal(19,0)")
    whole = (product - product % step).cast("decimal(38,0)")
    return (whole / step).cast("decimal(38,0)").try_cast("bigint")


def fixed_value(mantissa: Column, ndp: int) -> Column:
    """The number as a decimal."""
    return (mantissa.cast("decimal(18,0)") * F.lit(Decimal(1).scaleb(-ndp)).cast(f"decimal(18,{ndp})")).cast(KIND)


def fixed_divide(m1: Column, m2: Column, ndp2: int) -> Column:
    """The quotient at the first one's places, cut; null by nought and from 10**15 whole digits' worth on."""
    by = F.nullif(m2, F.lit(0).cast("bigint")).cast("decimal(19,0)")
    return F.call_function("div", (m1.cast("decimal(19,0)") * F.lit(Decimal(10) ** ndp2).cast("decimal(19,0)")).cast("decimal(38,0)"), by)


def fixed_parse(value: Column, ndp: int) -> Column:
    """Text as a mantissa of ``ndp`` places; digits after those are cut off, junk is null."""
    return (truncate(parse(value), ndp) * F.lit(10**ndp).cast("decimal(19,0)")).cast("decimal(38,0)").try_cast("bigint")


def fixed_text(mantissa: Column, ndp: int) -> Column:
    return text(fixed_value(mantissa, ndp))


def epsilon(value: Column) -> Column:
    """A step of the last decimal digit that a double of this size keeps: 15 digits below the first."""
    return F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))) - 14)


def nearly(a: Column, b: Column) -> Column:
    """Whether two doubles are the same but for the last digits."""
    return F.when(a == b, True).otherwise(F.abs(a - b) <= epsilon(F.greatest(F.abs(a), F.abs(b))))
