"""Running numbers over whole tables or large groups, without a sort in one task.

Rows are dealt by ranges of their order, so one task holds one range, and a group
that is most of the table lies in many ranges. A count per range and group says at
which number a range begins; that small table is all that is summed up in order.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topictide.lineage import cut_lineage



def numbered(
    df: DataFrame,
    order: Iterable[Column | str],
    by: Iterable[str] = (),
    name: str = "n",
    weight: str | None = None,
    total: str | None = None,
) -> DataFrame:
    """Add ``name``: 1, 2, 3, ... in ``order``, starting anew for each group of ``by``.

    With ``weight``, a column of whole numbers, ``name`` is the sum of the weights up to
    and including the row. ``total`` names a column for the last number of the group. Rows that are equal in ``order`` follow the digest of all their
    columns; wholly equal rows are spread over ranges too. Nulls order as Spark orders
    them and form a group of their own. The result is stored, so numbers never change.
    """
    by, columns = list(by), df.columns
    keys = [F.col(group).alias(f"_by{i}") for i, group in enumerate(by)]
    rows = df.select("*", *keys, F.xxhash64(*columns).alias("_digest"),
                     F.monotonically_increasing_id().alias("_row"))
    groups = [f"_by{i}" for i in range(len(by))]
    sort = [*groups, *order, "_digest", "_row"]
    dealt = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    step = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    dealt = cut_lineage(
        dealt.select(*columns, *groups, F.monotonically_increasing_id().alias("_at"),
                     step.alias("_step"))
        .withColumn("_range", F.shiftright("_at", 33))
    )
    sizes = dealt.groupBy("_range", *groups).agg(
        F.min("_at").alias("_from"), F.sum("_step").alias("_size")
    )
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    begins = sizes.select(
        F.col("_range").alias("_r"), *[F.col(g).alias(f"{g}r") for g in groups], "_from",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy(*groups)).alias("_total"),
    )
    same = F.col("_range") == F.col("_r")
    for group in groups:
        same = same & F.col(group).eqNullSafe(F.col(f"{group}r"))
    placed = dealt.join(begins, same)
    if weight is None:
        number = F.col("_at") - F.col("_from") + 1 + F.col("_before")
    else:
        # Within a range and group, whose rows one task holds.
        within = Window.partitionBy("_range", *groups).orderBy("_at")
        number = F.sum("_step").over(within) + F.col("_before")
    last = [] if total is None else [F.col("_total").alias(total)]
    return placed.select(*columns, number.alias(name), *last)
