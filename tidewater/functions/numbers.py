"""Numeric helpers with the rounding rules that results depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, places: int = 0) -> Column:
    """Halves go towards plus infinity, also below zero."""
    f = float(10**places)
    return F.floor(value * f + 0.5) / f


def number_or_null(text: Column) -> Column:
    """Text as a number; what is no finite number is null."""
    n = F.expr("try_cast(NULL as double)") if text is None else text.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def locale_number(text: Column) -> Column:
    """``1.234,5`` and ``12 %`` as numbers: dots group thousands where a comma is there, which is the decimal mark."""
    bare = F.regexp_replace(F.trim(text), r"[\s %]", "")
    return number_or_null(F.when(bare.contains(","), F.regexp_replace(F.regexp_replace(bare, r"\.", ""), ",", ".")).otherwise(bare))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is null or zero."""
    return F.when(b != 0, a / b)
