"""Connected parts of a graph given by its links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topictide.lineage import HOT_ROWS, cut_lineage, split_join


def connected(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``node, root`` with the smallest node of each connected part as its root.

    Each round takes the smallest root among the neighbours and then follows
    roots once, so long chains halve. Rounds are written to the checkpoint folder.
    """
    both = cut_lineage(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"),
                                                        F.col("a").alias("b"))).distinct()
    )
    roots = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
                        .select("node", F.least("node", "root").alias("root")))
    nodes = roots.count()
    while True:
        near = (
            both.join(roots, both["a"] == roots["node"])
            .groupBy("b").agg(F.min("root").alias("near"))
        )
        moved = roots.join(near, roots["node"] == near["b"], "left").select(
            "node", F.col("root").alias("old"),
            F.least("root", F.coalesce("near", "root")).alias("via"),
        )
        jump = roots.select(F.col("node").alias("via"), F.col("root").alias("next"))
        step = cut_lineage(
            split_join(moved, jump, "via", "left", hot_rows, nodes).select(
                "node", "old", F.least("via", F.coalesce("next", "via")).alias("root")
            )
        )
        changed = step.where(F.col("old") != F.col("root")).limit(1).count()
        roots = step.select("node", "root")
        if not changed:
            return roots
