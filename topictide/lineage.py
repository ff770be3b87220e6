"""Materialisation points and size checks.

Executors come and go, so anything reused across jobs is written to the shared
checkpoint folder of the cluster, never kept in executor-local storage.
"""

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it was counted and lies under both bounds.
BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
# A key with more rows than this is kept out of shuffles on that key.
HOT_ROWS = 1_000_000


PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def import_path(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed: in local runs from its folder."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *filter(None, paths)])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of ``spark.checkpoint.dir``; a temp folder only on local masters."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and context.master.startswith("local"):
        shared = tempfile.mkdtemp(prefix="topictide-checkpoint-")
    if shared is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def measured(df: DataFrame) -> tuple[DataFrame, int, int]:
    """Checkpoint ``df`` and return it with its row count and a byte estimate."""
    df = cut_lineage(df)
    width = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    rows, size = df.agg(F.count(F.lit(1)), width).first()
    return df, rows, size or 0


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` after measuring it; above the bounds leave the join to Catalyst/AQE."""
    df, rows, size = measured(df)
    if rows <= BROADCAST_MAX_ROWS and size <= BROADCAST_MAX_BYTES:
        return F.broadcast(df)
    return df


def split_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Equi-join with a ``small`` side of distinct keys, where one key may hold much of ``big``.

    Keys of more than ``hot_rows`` rows, at most ``rows / hot_rows`` many, are
    joined map-side; the others are shuffled. The result is that of one join.
    ``rows`` is the size of ``big`` if it is known: a table of no more than
    ``hot_rows`` rows has no such key.
    """
    if rows is not None and rows <= hot_rows:
        return big.join(small, key, how)
    counted = big.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    hot, keys, _ = measured(counted.where(F.col("_rows") > hot_rows).select(key))
    if keys == 0 or keys > BROADCAST_MAX_ROWS:
        return big.join(small, key, how)
    hot = F.broadcast(hot)
    few = F.broadcast(small.join(hot, key, "left_semi"))
    return (
        big.join(hot, key, "left_semi").join(few, key, how)
        .unionByName(big.join(hot, key, "left_anti").join(small, key, how))
    )
