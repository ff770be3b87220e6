"""Daily Parquet tables: reading ranges of days, writing, rewriting."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topictide.sources.paths import day_of_file

DAY_STEM = r"^\d{4}-\d{2}-\d{2}\.parquet$"


def read_days(
    spark: SparkSession,
    root: str,
    start: str | None = None,
    end: str | None = None,
    year: int | None = None,
) -> DataFrame:
    """Rows of a table partitioned by ``dt``; the bounds prune whole partitions."""
    return between_days(spark.read.parquet(root), start, end, year)


def between_days(
    df: DataFrame, start: str | None = None, end: str | None = None, year: int | None = None
) -> DataFrame:
    """Rows whose ``dt`` lies in the range and the year."""
    if year is not None:
        df = df.where(F.col("dt").between(F.lit(f"{year}-01-01").cast("date"),
                                          F.lit(f"{year}-12-31").cast("date")))
    if start is not None:
        df = df.where(F.col("dt") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("dt") <= F.lit(end).cast("date"))
    return df


def read_day_files(spark: SparkSession, root: str, year: int | None = None) -> DataFrame:
    """Rows of flat ``yyyy-mm-dd.parquet`` files with their day as ``dt``; other files are ignored."""
    pattern = f"{year if year is not None else '*'}-*.parquet"
    files = spark.read.option("pathGlobFilter", pattern).parquet(root)
    return files.where(F.col("_metadata.file_name").rlike(DAY_STEM)).withColumn("dt", day_of_file())


def write_days(df: DataFrame, root: str) -> None:
    """Write by ``dt``, replacing only the days present. No rows, no partition.

    The rebalance hint lets AQE split a heavy day over several tasks and files
    and merge light ones.
    """
    (
        df.hint("rebalance", "dt")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dt")
        .parquet(root)
    )


def rewrite_days(
    spark: SparkSession, root: str, new_root: str, change, start: str | None = None,
    end: str | None = None,
) -> None:
    """Read days, apply ``change(df)``, write them to another root.

    A new root instead of a rewrite in place: a lost job leaves the source
    whole, and a day that becomes empty does not keep its old rows.
    """
    if root.rstrip("/") == new_root.rstrip("/"):
        raise ValueError("new_root must differ from root")
    write_days(change(read_days(spark, root, start, end)), new_root)
