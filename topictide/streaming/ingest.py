"""Resumable extraction of daily post files.

The stream's checkpoint remembers which files are done, so a restart goes on
where the last run ended.
"""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from topictide import schemas
from topictide.operators.dedupe import dedupe_posts, distinct_posts
from topictide.operators.match import extract_posts
from topictide.sources.days import write_days
from topictide.sources.paths import day_of_file


def ingest_days(
    spark: SparkSession,
    source: str,
    root: str,
    checkpoint: str,
    first: Iterable[str],
    second: Iterable[str],
    max_files: int | None = None,
    days: str | None = None,
) -> StreamingQuery:
    """Extract posts of all new files under ``source`` into ``root`` by day, then stop.

    Each micro-batch replaces only its own ``dt, batch`` partitions, so a batch
    repeated after a failure leaves the same table. With ``days``, that folder holds one
    row per post and day over all batches so far: a batch makes the days that it touches
    anew from ``root``, so whatever a failure leaves there, the repeated batch sets right.
    """
    first, second = list(first), list(second)
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(source).select("value", day_of_file().alias("dt"))

    def write_batch(batch: DataFrame, number: int) -> None:
        posts = extract_posts(batch, first, second).withColumn("batch", F.lit(number))
        (
            posts.hint("rebalance", "dt")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("dt", "batch")
            .parquet(root)
        )
        if days is not None:
            written = spark.read.parquet(root)
            touched = written.where(F.col("batch") == number).select("dt").distinct()
            of_days = written.join(touched, "dt", "left_semi")
            write_days(dedupe_posts(of_days.select("dt", *schemas.EXTRACTED_COLUMNS)), days)

    return (
        lines.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_ingested(spark: SparkSession, root: str) -> DataFrame:
    """Extracted posts of all batches; a day spread over batches is made distinct again."""
    return distinct_posts(spark.read.parquet(root).select("dt", *schemas.EXTRACTED_COLUMNS))
