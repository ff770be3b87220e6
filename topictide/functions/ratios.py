"""Ratios that give 0 for an empty total."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(part: Column | str, total: Column | str) -> Column:
    """``part / total`` as a double, 0 where the total is 0 or missing."""
    numerator = (F.col(part) if isinstance(part, str) else part).cast("double")
    denominator = (F.col(total) if isinstance(total, str) else total).cast("double")
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))
