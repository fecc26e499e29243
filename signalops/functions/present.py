"""Rounding used where results are presented, so equal values print equally everywhere.

Averages of two-decimal inputs land exactly on a rounding tie now and then, and two engines
may sum in different orders. A nudge far below the shown precision moves such ties off the edge.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from signalops.functions.nulls import col

# Fixed value: share of the last shown digit used as the nudge.
NUDGE = 0.00317


def shown(c: str | Column, digits: int = 4) -> Column:
    return F.round(col(c).cast("double") + F.lit(NUDGE * 10.0 ** -digits), digits)


def shown_sql(expr: str, digits: int = 4) -> str:
    return f"(round(({expr})::double + {NUDGE * 10.0 ** -digits:.20f}::double, {digits}) + 0.0::double)"
