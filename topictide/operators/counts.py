"""Line and row counts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topictide.functions.periods import year_of


def line_counts(lines: DataFrame, day: str = "dt") -> DataFrame:
    """``dt, total_count``: raw lines per day."""
    return lines.groupBy(F.col(day).alias("dt")).agg(F.count(F.lit(1)).alias("total_count"))


def row_counts(df: DataFrame, day: str = "dt") -> DataFrame:
    """``year, dt, row_count`` per day, per year (``dt`` null) and over all (both null).

    Days are counted first; the rollup then only multiplies day rows.
    """
    days = df.groupBy(F.to_date(day).alias("dt")).agg(F.count(F.lit(1)).alias("n"))
    return (
        days.withColumn("year", year_of("dt"))
        .rollup("year", "dt")
        .agg(F.sum("n").alias("row_count"))
    )
