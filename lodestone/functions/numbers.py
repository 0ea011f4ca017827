"""Numeric functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors from the tool's internal units.
UNIT_FACTORS = {"thermal_expansion_inv_C": 1.8, "porosity": 10.0}


def clean_number(x: Column, decimals: int = 4) -> Column:
    """Rounded to decimals; a value that would vanish keeps four significant digits instead."""
    small = (x != 0) & (F.round(x, decimals) == 0)
    return F.when(small, F.format_string("%.3e", x).cast("double")).otherwise(F.round(x, decimals))


def converted(x: Column, key: str) -> Column:
    return x * F.lit(UNIT_FACTORS.get(key, 1.0))


def nonzero(x: Column) -> Column:
    """Null in place of zero."""
    return F.nullif(x, F.lit(0.0))


def percent(share: Column) -> Column:
    """Whole percents from 0 to 100, halves away from zero."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(share * 100).cast("int")))


def points(after: Column, before: Column) -> Column:
    """The change between two shares in percentage points."""
    return F.round((after - before) * 100, 4)


def tier(score: Column) -> Column:
    """Five tiers of a percentage; null is a tier of its own."""
    return (
        F.when(score.isNull(), "none").when(score < 15, "very low").when(score < 30, "low").when(score < 45, "medium").when(score < 70, "high").otherwise("very high")
    )


def cosine_band(x: Column) -> Column:
    return F.when(x >= 0.85, "near identical").when(x >= 0.7, "strong").when(x >= 0.5, "related").when(x >= 0.3, "weak").otherwise("unrelated")
