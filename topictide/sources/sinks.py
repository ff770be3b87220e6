"""Result tables and text sets."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BYTE_ORDER_MARK = chr(0xFEFF)


def write_texts_by_key(
    df: DataFrame, path: str, key: str | list[str], text: str, keep_others: bool = False
) -> None:
    """One folder of text lines per key; line breaks inside a text become blanks.

    A rerun replaces the whole set, so keys that no longer exist are gone.
    ``keep_others`` replaces only the keys at hand, as for one year of many.
    """
    keys = [key] if isinstance(key, str) else list(key)
    line = F.regexp_replace(text, r"[\r\n]+", " ").alias("value")
    (
        df.where(F.col(text).isNotNull())
        .select(*keys, line)
        .hint("rebalance", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if keep_others else "static")
        .partitionBy(*keys)
        .text(path)
    )


def read_texts_by_key(spark: SparkSession, path: str) -> DataFrame:
    """Text sets written by key, with their keys as columns."""
    return spark.read.text(path)


def merge_years(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Texts of all years per key, repeats across years kept; ``path`` is partitioned by year, key."""
    texts = read_texts_by_key(spark, path)
    return texts.where(F.col("year").between(first, last)).select("kid", "value")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mark: bool = False) -> None:
    """A result table as parquet, JSON lines or CSV with header.

    ``mark`` puts a byte order mark before the CSV header, as spreadsheet
    programs expect it.
    """
    if fmt == "csv":
        if mark:
            first = df.columns[0]
            df = df.withColumnRenamed(first, BYTE_ORDER_MARK + first)
        df.write.mode("overwrite").csv(path, header=True, escape='"')
    elif fmt == "json":
        df.write.mode("overwrite").json(path)
    elif fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_ordered(
    df: DataFrame, path: str, order: list[Column | str], fmt: str = "parquet", files: int | None = None
) -> None:
    """A result table in a total order: numbered files, each one range of it, sorted.

    There are ``files`` ranges, or as many as its size asks for. Rows that tie in ``order`` are sorted by all columns. Ranges come from one range
    exchange, so no task sorts the whole table; files in the order of their names hold the
    rows in order.
    """
    keys = [*order, *df.columns]
    dealt = df.repartitionByRange(*keys) if files is None else df.repartitionByRange(files, *keys)
    write_table(dealt.sortWithinPartitions(*keys), path, fmt)


def read_ordered(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Rows of an ordered table with their place, ``file`` and ``row``: sorting by both gives the order."""
    options = {"header": True, "escape": '"'} if fmt == "csv" else {}
    rows = spark.read.options(**options).format(fmt).load(path)
    place = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    return rows.select("*", place.alias("file"), F.monotonically_increasing_id().alias("row"))
