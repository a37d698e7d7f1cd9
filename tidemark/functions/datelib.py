"""Host functions over dates, outside of the expression language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kernels import JULIAN_EPOCH, spark_picture


def day_of_week(d: Column) -> Column:
    """1 for Sunday to 7 for Saturday."""
    return F.dayofweek(d)


def day_name(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def month_name(d: Column) -> Column:
    return F.date_format(d, "MMMM")


def is_leap(d: Column) -> Column:
    return F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31))) == 366


def julian_day(d: Column) -> Column:
    return (F.unix_date(d) + JULIAN_EPOCH).cast("long")


def from_julian_day(n: Column) -> Column:
    return F.date_from_unix_date((n - JULIAN_EPOCH).cast("int"))


def format_date(d: Column, picture: str) -> Column:
    """A date in a picture such as MM/DD/YY or CCYY-MM-DD."""
    return F.date_format(d, spark_picture(picture))


def datetime_text(t: Column) -> Column:
    return F.date_format(t, "yyyyMMddHH:mm:ss")
