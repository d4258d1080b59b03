"""Rounding at the edge of a report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, digits: int) -> Column:
    """Ties go to the even digit, as the published figures do."""
    return F.bround(value, digits)
