"""Text, encodings, enumerations and flags, as Columns."""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, IntegerType, StringType


def replace_first(text: Column, pattern: str, to: str) -> Column:
    """The first match of ``pattern`` replaced; ``to`` may name the pattern's groups from $1 on."""
    shifted = re.sub(r"\$(\d+)", lambda m: f"${int(m[1]) + 2}", to)
    return F.regexp_replace(text, rf"(?s)^(.*?)({pattern})(.*)$", f"$1{shifted}${re.compile(pattern).groups + 3}")


def camel(text: Column) -> Column:
    """snake_case as snakeCase."""
    parts = F.split(text, "_")
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)))
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def snake(text: Column) -> Column:
    """camelCase as camel_case."""
    return F.lower(F.regexp_replace(text, r"(?<=[^_])([A-Z])", "_$1"))


def quote_csv(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def quote_c(text: Column) -> Column:
    """A C string literal."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(name))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def chomp(text: Column) -> Column:
    """The text without line ends and white space at its end."""
    return F.regexp_replace(text, r"\s+$", "")


def splice(text: Column, at: int, length: int, new: Column) -> Column:
    """``length`` characters from the 0-based place ``at`` replaced."""
    return F.overlay(text, new, at + 1, length)


def to_bool(text: Column, strict: bool = False) -> Column:
    """1, y, yes and true are true in any case; all else is false, or null if ``strict`` and not 0, n, no or false."""
    low = F.lower(text)
    false = F.when(low.isin("0", "n", "no", "false"), F.lit(False)) if strict else F.when(text.isNotNull(), F.lit(False))
    return F.when(low.isin("1", "y", "yes", "true"), F.lit(True)).otherwise(false)


@pandas_udf(StringType())
def base32(raw: pd.Series) -> pd.Series:
    """Bytes in base 32 without padding."""
    return raw.map(lambda x: None if x is None else base64.b32encode(bytes(x)).decode().rstrip("="))


@pandas_udf(BinaryType())
def unbase32(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else base64.b32decode(x.upper() + "=" * (-len(x) % 8)))


@pandas_udf(IntegerType())
def width(text: pd.Series) -> pd.Series:
    """Columns that the text takes on a terminal: wide characters two, combining ones none."""

    def one(x: str | None) -> int | None:
        return None if x is None else sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in x)

    return pd.Series([one(x) for x in text], dtype="Int32")


# -- enumerations and flags; ``names`` is name -> value, and several names may have one value


def _map(pairs: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def enum_value(name: Column, names: Mapping[str, int]) -> Column:
    """The value of a name, null for an unknown one."""
    return F.try_element_at(_map(names), name)


def enum_name(value: Column, names: Mapping[str, int]) -> Column:
    """The first name of a value, null for an unknown one."""
    first: dict[int, str] = {}
    for n, v in names.items():
        first.setdefault(v, n)
    return F.try_element_at(_map(first), value)


def flag_names(value: Column, names: Mapping[str, int]) -> Column:
    """The names of the set bits, as A|B; ``names`` is name -> bit number."""
    shown = F.array(*[F.when(value.bitwiseAND(F.lit(1 << bit)) != 0, F.lit(n)) for n, bit in names.items()])
    return F.array_join(shown, "|")


def flag_value(text: Column, names: Mapping[str, int]) -> Column:
    """The bits of names joined by |; unknown names count for nothing."""
    bits = _map({n: 1 << b for n, b in names.items()})
    return F.aggregate(F.array_distinct(F.split(text, r"\|")), F.lit(0), lambda acc, n: acc.bitwiseOR(F.coalesce(F.try_element_at(bits, n), F.lit(0))))


def venue_flags(venue: Column, value: Column, names: Mapping[str, Mapping[str, int]]) -> Column:
    """VENUE:FLAGS with each venue's own names; nothing for a venue without."""
    shown = F.lit(None).cast("string")
    for v, own in names.items():
        shown = F.when(venue == v, F.concat(F.lit(f"{v}:"), flag_names(value, own))).otherwise(shown)
    return shown
