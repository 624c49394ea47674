"""Numeric expressions. NULL is the one missing value; NaN and infinities become NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")

# Fixed pattern: a plain decimal, an infinity or a NaN, with blanks around it.
PLAIN_NUMBER = (
    r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"
)


def is_inf(col: Column) -> Column:
    return F.abs(col) == F.lit(INF)


def is_finite(col: Column) -> Column:
    """False, never NULL, for NULL, NaN and infinities."""
    return F.coalesce(~F.isnan(col) & (F.abs(col) < F.lit(INF)), F.lit(False))


def finite(col: Column) -> Column:
    """The value as double, NULL where it is missing or not finite."""
    col = col.cast("double")
    return F.when(is_finite(col), col)


def inf_to_null(col: Column) -> Column:
    """NULL for NaN and infinities; the type of the column stays."""
    return F.when(~F.isnan(col) & (F.abs(col) < F.lit(INF)), col)


def to_number(col: Column) -> Column:
    """Lenient text to double: what is not a plain number is NULL."""
    text = col.cast("string")
    return F.when(text.rlike(PLAIN_NUMBER), F.trim(text).try_cast("double"))


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where the denominator is 0 or the ratio is unknown."""
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))
