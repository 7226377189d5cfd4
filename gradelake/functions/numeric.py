"""Rounding and small aggregates with exactly defined results.

All rounding is half toward positive infinity on the scaled binary value, which ``round`` is not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_decimals(value: Column, decimals: int = 0) -> Column:
    scale = float(10**decimals)
    return F.floor(value * scale + F.lit(0.5)).cast("double") / F.lit(scale)


def to_half(value: Column) -> Column:
    """Nearest half point."""
    return F.floor(value * 2.0 + F.lit(0.5)).cast("double") / F.lit(2.0)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value))


def mean_or_zero(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def spread(value: Column) -> Column:
    return F.max(value) - F.min(value)


def share(condition: Column) -> Column:
    """Share of rows that meet a condition; rows where it is null do not count."""
    return F.avg(condition.cast("int"))


def upper_median(value: Column) -> Column:
    """The element at ``floor(n / 2)`` of the sorted values, counted from 0; null without any."""
    ordered = F.sort_array(F.collect_list(value))
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def order_statistic(value: Column, part: float) -> Column:
    """The element at ``floor(n * part)`` of the sorted values, counted from 0; null without any."""
    ordered = F.sort_array(F.collect_list(value))
    return F.get(ordered, F.least(F.floor(F.size(ordered) * part).cast("int"), F.size(ordered) - 1))


def first_least(*named: tuple[str, Column]) -> Column:
    """The name of the least value, the first of equals."""
    return F.array_min(F.array(*[F.struct(v.alias("value"), F.lit(i).alias("at"), F.lit(n).alias("name")) for i, (n, v) in enumerate(named)]))["name"]


def percent_text(part: Column, whole: Column) -> Column:
    """``12.3%``; a dash when there is nothing to divide by."""
    return F.when(whole == 0, F.lit("-")).otherwise(F.concat(F.format_string("%.1f", to_decimals(part / whole * 100.0, 1)), F.lit("%")))
