"""Calendar labels and day lists."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Labels of the quarters.
QUARTER_LABELS = ["1-3", "4-6", "7-9", "10-12"]
WINDOWS = ("month", "quarter", "year")


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _day_text(day: Column | str) -> Column:
    # A date prints as yyyy-MM-dd; cutting that is cheaper than formatting a timestamp.
    return _col(day).cast("date").cast("string")


def month_of(day: Column | str) -> Column:
    """``yyyy-MM``."""
    return F.substring(_day_text(day), 1, 7)


def year_of(day: Column | str) -> Column:
    """``yyyy``."""
    return F.substring(_day_text(day), 1, 4)


def quarter_of(day: Column | str) -> Column:
    """``yyyy-1-3``, ``yyyy-4-6``, ``yyyy-7-9`` or ``yyyy-10-12``."""
    labels = F.array(*[F.lit(label) for label in QUARTER_LABELS])
    return F.concat(year_of(day), F.lit("-"), F.element_at(labels, F.quarter(_col(day))))


def window_label(day: Column | str, window: str) -> Column:
    """Label of the month, quarter or year a day lies in."""
    labels = {"month": month_of, "quarter": quarter_of, "year": year_of}
    if window not in labels:
        raise ValueError(f"window must be one of {WINDOWS}, not {window!r}")
    return labels[window](day)


def day_list(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every day from ``start`` to ``end``, both included, leap days too."""
    days = F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    return spark.range(1).select(F.explode(days).alias("dt"))


def half_year(year: int, half: int) -> tuple[str, str]:
    """First and last day of half ``0`` or ``1`` of a year, or of the whole year for ``2``."""
    if half not in (0, 1, 2):
        raise ValueError("half must be 0, 1 or 2")
    start = f"{year}-07-01" if half == 1 else f"{year}-01-01"
    end = f"{year}-06-30" if half == 0 else f"{year}-12-31"
    return start, end
