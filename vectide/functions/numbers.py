"""Rounding used in reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sig3(value: Column) -> Column:
    """Round to three significant digits; zero stays zero."""
    size = F.floor(F.log10(F.when(value == 0, F.lit(1.0)).otherwise(F.abs(value.cast("double"))))).cast("int")
    shift = F.pow(F.lit(10.0), F.abs(2 - size))
    # Dividing by an exact power of ten is exact enough; multiplying by 0.01 is not.
    rounded = F.when(size > 2, F.round(value / shift) * shift).otherwise(F.round(value * shift) / shift)
    return F.when(value == 0, F.lit(0.0)).otherwise(rounded)
