"""Share of flagged topics per month, quarter or year."""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topictide.functions.periods import month_of, window_label, year_of
from topictide.functions.ratios import safe_ratio
from topictide.operators.dedupe import hottest_per_text
from topictide.operators.flags import hot_enough

MODES = ("additive", "weighted")


def flag_share(
    topics: DataFrame,
    window: str = "year",
    mode: str = "additive",
    cutoff: int | None = None,
    exclude: Iterable[str] = (),
    day: str = "date",
    text: str = "text",
    hot: str = "hot",
    flag: str = "flag",
    ties: Iterable[str] = ("timestamp",),
) -> DataFrame:
    """``period, flagged, total, proportion`` per window.

    ``additive`` counts rows. ``weighted`` keeps the hottest row of each text
    within a month and sums heat. Quarters and years add up their months, so a
    topic seen in two months counts twice. ``cutoff`` drops rows below that
    heat, ``exclude`` leaves out window labels.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    rows = topics.withColumn("month", month_of(day))
    if mode == "weighted":
        rows = hottest_per_text(rows, ["month"], text, hot, ties)
    if cutoff is not None:
        rows = hot_enough(rows, cutoff, hot)
    weight = F.col(hot) if mode == "weighted" else F.lit(1)
    # Sums add up over months, so one grouping by the window label is enough.
    sums = rows.groupBy(window_label(day, window).alias("period")).agg(
        F.sum(F.col(flag) * weight).cast("bigint").alias("flagged"),
        F.sum(weight).cast("bigint").alias("total"),
    )
    left_out = list(exclude)
    if left_out:
        sums = sums.where(~F.coalesce(F.col("period").isin(left_out), F.lit(False)))
    return sums.withColumn("proportion", safe_ratio("flagged", "total"))


def missing_share(topics: DataFrame, hot: str = "hot") -> DataFrame:
    """``missing_share``: part of all rows without heat."""
    known = safe_ratio(F.count(hot), F.count(F.lit(1)))
    return topics.agg((F.lit(1.0) - known).alias("missing_share"))


def yearly_flagged_share(topics: DataFrame, day: str = "date", flag: str = "flag") -> DataFrame:
    """``year, flagged, total, proportion`` over all rows, before any dedupe."""
    return topics.groupBy(year_of(day).alias("year")).agg(
        F.sum(flag).cast("bigint").alias("flagged"), F.count(F.lit(1)).alias("total")
    ).withColumn("proportion", safe_ratio("flagged", "total"))
