"""Arithmetic that is defined for every input, and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(column: str | Column) -> Column:
    """A measure as a double: integer sums cannot overflow."""
    return (F.col(column) if isinstance(column, str) else column).cast("double")


def ratio(top: Column, bottom: Column) -> Column:
    """Null when the denominator is zero or missing."""
    return F.try_divide(top, bottom)


def pct_change(new: Column, old: Column) -> Column:
    """Percent change on the size of the old value; null from zero."""
    return ratio(new - old, F.abs(old)) * 100


def pct_of(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(ratio(part, whole) * 100, digits)


def pearson(x: str, y: str) -> Column:
    """Pearson's r over rows where both are present; null for fewer than two
    such rows or for a constant column."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, number(x)), F.when(both, number(y))
    return ratio(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def display(value: Column, subtype: Column | str | None) -> Column:
    """A value as people read it: percent, rupees in lakh and crore, or a count."""
    kind = F.lit(subtype) if subtype is None or isinstance(subtype, str) else subtype
    v = value.cast("double")
    size = F.abs(v)
    percent = F.format_string("%.1f%%", F.when(size <= 1, v * 100).otherwise(v))
    money = (F.when(size >= 1e7, F.format_string("₹%.2f Cr", v / 1e7))
             .when(size >= 1e5, F.format_string("₹%.2f L", v / 1e5))
             .otherwise(F.format_string("₹%,.0f", v)))
    plain = F.when((size >= 1e5) | (v == F.floor(v)), F.format_string("%,.0f", v)).otherwise(
        F.format_string("%,.2f", v))
    return (F.when(v.isNull() | F.isnan(v), F.lit("-"))
            .when(kind == "percentage", percent).when(kind == "currency", money).otherwise(plain))


def signed(value: Column, subtype: Column | str | None) -> Column:
    return F.concat(F.when(value > 0, F.lit("+")).otherwise(F.lit("−")), display(F.abs(value), subtype))


def words(name: str) -> str:
    return name.replace("_", " ").strip()
