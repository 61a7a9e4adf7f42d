"""Closed formulas of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def maintainability_index(loc: Column, cyclomatic: Column, cognitive: Column) -> Column:
    """0 to 100 from lines of code and complexity; the volume is taken as loc * ln(loc)."""
    lines = F.greatest(loc.cast("double"), F.lit(1.0))
    volume = F.greatest(lines * F.log(lines), F.lit(1.0))
    raw = F.lit(171.0) - F.log(volume) * 5.2 - (cyclomatic * 0.7 + cognitive * 0.3) * 0.23 - F.log(lines) * 16.2
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100.0 / 171.0))


def ratio(part: Column, whole: Column, default: float = 100.0) -> Column:
    """A percentage, or the default where there is nothing to divide by."""
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(default))


def health(value: Column, good: float, fair: float, falling: bool = False) -> Column:
    """good / fair / poor by two limits; ``falling``: small values are good."""
    a, b = (value <= good, value <= fair) if falling else (value >= good, value >= fair)
    return F.when(a, "good").when(b, "fair").otherwise("poor")
