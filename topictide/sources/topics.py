"""Topic tables: monthly CSV files and their repair."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topictide import schemas
from topictide.functions.periods import month_of

# Texts a CSV reader takes as a missing number.
MISSING_NUMBERS = [
    "", "None", "NaN", "nan", "NA", "N/A", "n/a", "null", "NULL", "#N/A", "<NA>",
]


def read_topics(spark: SparkSession, path: str | list[str], header: bool = False) -> DataFrame:
    """Topic rows ``timestamp, date, text, hot, flag``; ``hot`` is null when missing."""
    raw = spark.read.schema(schemas.TOPIC_CSV).csv(path, header=header, escape='"')
    return typed_topics(raw)


def typed_topics(raw: DataFrame) -> DataFrame:
    """Typed view of all-string topic rows. ``12.0``, as written beside missing values, is 12."""
    number = F.when(~F.col("hot").isin(MISSING_NUMBERS), F.col("hot"))
    return raw.select(
        "timestamp",
        F.col("date").try_cast("date").alias("date"),
        "text",
        _whole_number(number, "bigint").alias("hot"),
        _whole_number(F.col("flag"), "int").alias("flag"),
    )


def _whole_number(column: Column, kind: str) -> Column:
    return F.coalesce(column.try_cast(kind), column.try_cast("double").try_cast(kind))


def repair_topic_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """CSV lines as string topic rows; a line of nine fields is two rows glued together.

    The fifth field of a glued line is the one-digit flag of the first row
    followed by the timestamp of the second. Lines of other widths are dropped.
    """
    fields = F.split(column, ",", -1)

    def row(values: list[Column]) -> Column:
        return F.struct(*[v.alias(n) for v, n in zip(values, schemas.TOPIC_COLUMNS, strict=True)])

    plain = row([F.get(fields, i) for i in range(5)])
    seam = F.get(fields, 4)
    first = row([F.get(fields, i) for i in range(4)] + [F.substring(seam, 1, 1)])
    second = row([F.substr(seam, F.lit(2))]
                 + [F.get(fields, i) for i in range(5, 9)])
    rows = F.when(F.size(fields) == 5, F.array(plain)).when(
        F.size(fields) == 9, F.array(first, second)
    )
    return lines.select(F.explode(rows).alias("row")).select("row.*")


def write_topics_by_month(topics: DataFrame, path: str) -> None:
    """Topic rows as CSV by month of ``date``; a rerun replaces the months it holds."""
    (
        topics.withColumn("month", month_of("date"))
        .hint("rebalance", "month")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month")
        .csv(path, header=True, escape='"')
    )
