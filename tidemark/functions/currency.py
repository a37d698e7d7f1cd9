"""Currency: exact arithmetic with four decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "decimal(19,4)"


def _money(x: Column) -> Column:
    return x.cast(TYPE)


def add(a: Column, b: Column) -> Column:
    return (_money(a) + _money(b)).cast(TYPE)


def subtract(a: Column, b: Column) -> Column:
    return (_money(a) - _money(b)).cast(TYPE)


def multiply(a: Column, b: Column) -> Column:
    return (_money(a) * _money(b)).cast(TYPE)


def divide(a: Column, b: Column) -> Column:
    """Rounded to four decimals; x / 0 is 0."""
    return F.when(_money(b) == 0, F.lit(0).cast(TYPE)).otherwise(F.try_divide(_money(a), _money(b)).cast(TYPE))


def modulo(a: Column, b: Column) -> Column:
    """The rest of a division, with the sign of a; x mod 0 is 0."""
    return F.when(_money(b) == 0, F.lit(0).cast(TYPE)).otherwise(F.try_mod(_money(a), _money(b)).cast(TYPE))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.signum((_money(a) - _money(b)).cast("double")).cast("int")


def to_text(a: Column) -> Column:
    return _money(a).cast("string")
