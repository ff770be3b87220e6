"""Chat formatting of logged conversations, in DataFrame functions only.

Logs hold snapshots: the same conversation after two turns, after four, and so on. A
rolling hash over the turns names every prefix; a conversation whose hash is a proper prefix
of another one is dropped by an anti-join, and so are all but the smallest id among equal
ones. The others are rendered turn by turn.

No task holds a whole conversation: turns are numbered by ranges of their order, and rolling
hashes are combined from those of runs of turns and of blocks of runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topictide.operators.numbering import numbered

#: Turns that are rendered into one row; a longer conversation gives several parts.
PART_TURNS = 256
#: Turns of a run and runs of a block, whose hashes one task combines in order.
RUN = 1024
KEYS = ("n_turns", "_hash1", "_hash2")
HASHES = ("_hash1", "_hash2")


def placed_turns(turns: DataFrame) -> DataFrame:
    """Turns with ``_place``, from 1, and ``_turns``, the size of the conversation; stored."""
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    return numbered(turns.select("conv_id", "turn", "role", "text"), order, by=["conv_id"], name="_place", total="_turns")


def rolling_hashes(placed: DataFrame) -> DataFrame:
    """conv_id, ``_place``, ``_turns`` and a 128-bit hash of all turns up to each.

    Hashes of (place, role, text) are combined by exclusive or: within a run of ``RUN`` turns,
    over the earlier runs of its block, and over the earlier blocks.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    missing = F.col("role").isNull().cast("int") * 2 + F.col("text").isNull().cast("int")
    steps = placed.select(
        "conv_id", "_place", "_turns",
        *[F.xxhash64(F.lit(salt), F.col("_place"), missing, role, F.lit(salt), text).alias(c) for salt, c in enumerate(HASHES, 1)],
        F.floor((F.col("_place") - 1) / RUN).alias("_run"),
    )
    steps = steps.withColumn("_block", F.floor(F.col("_run") / RUN))
    # a conversation of one run has nothing before its run
    runs = _combined(steps.where(F.col("_turns") > RUN), "conv_id", "_block", "_run")
    blocks = _before(_combined(runs, "conv_id", "_block"), "_block", "conv_id").select(
        F.col("conv_id").alias("_id"), F.col("_block").alias("_b"), *[F.col(c).alias(f"{c}b") for c in HASHES]
    )
    runs = _before(runs, "_run", "conv_id", "_block").join(
        blocks, F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("_block") == F.col("_b"))
    )
    runs = runs.select("_id", F.col("_run").alias("_r"), *[F.col(c).bitwiseXOR(F.col(f"{c}b")).alias(f"{c}r") for c in HASHES])
    within = Window.partitionBy("conv_id", "_run").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumns({c: F.bit_xor(c).over(within) for c in HASHES})
    steps = steps.join(runs, F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("_run") == F.col("_r")), "left")
    whole = [F.col(c).bitwiseXOR(F.coalesce(F.col(f"{c}r"), F.lit(0).cast("long"))).alias(c) for c in HASHES]
    return steps.select("conv_id", "_place", "_turns", *whole)


def _combined(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.bit_xor(c).alias(c) for c in HASHES])


def _before(rows: DataFrame, order: str, *by: str) -> DataFrame:
    """``rows`` with the combined hashes of all rows before each in place of its own."""
    earlier = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({c: F.coalesce(F.bit_xor(c).over(earlier), F.lit(0).cast("long")) for c in HASHES})


def maximal_conversations(placed: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that no other one continues or repeats."""
    steps = rolling_hashes(placed).withColumnRenamed("_place", "n_turns")
    whole = steps.where(F.col("n_turns") == F.col("_turns")).groupBy(*KEYS).agg(
        F.min("conv_id").alias("conv_id"), F.max(F.col("conv_id").isNull()).alias("_null")
    )
    prefixes = steps.where(F.col("n_turns") < F.col("_turns")).select(*KEYS).dropDuplicates()
    # a null id sorts first among equal conversations
    found = whole.join(prefixes, list(KEYS), "left_anti")
    return found.select(F.when(~F.col("_null"), F.col("conv_id")).alias("conv_id"), F.col("n_turns").cast("long"))


def render(placed: DataFrame, maximal: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per conversation and part: conv_id, part, n_turns, text.

    A turn becomes ``<|role|>``, a line feed, its trimmed text, ``<|end|>`` and a line feed;
    parts of a conversation, joined in order, are its whole text. Conversations are met part
    by part, so that a long one is no hot key.
    """
    role = F.coalesce(F.col("role"), F.lit("user"))
    text = F.trim(F.coalesce(F.col("text"), F.lit("")))
    line = F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))
    # keys without nulls, so that the grouping needs no other exchange than the join
    keys = [F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_id"), F.col("conv_id").isNull().alias("_none")]
    parts = maximal.select(*keys, "n_turns", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_turns") - 1) / part_turns))).alias("part"))
    lines = placed.select(*keys, "conv_id", "_place", line.alias("_line"), F.floor((F.col("_place") - 1) / part_turns).alias("part"))
    grouped = lines.join(parts, ["_id", "_none", "part"]).groupBy("_id", "_none", "part", "n_turns").agg(
        F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("_place", "_line"))).alias("_lines")
    )
    text = F.array_join(F.transform("_lines", lambda x: x["_line"]), "")
    return grouped.select("conv_id", F.col("part").cast("int").alias("part"), "n_turns", text.alias("text"))


def format_chats(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Rendered maximal conversations.

    Turns are ordered by turn, role and text, nulls first, so ties have one order; a repeated
    turn row counts as a further turn. Rows without a conversation id form one conversation
    together. A null role renders as ``user``, a null text as empty, but neither equals the
    other in prefixes. An empty table gives no rows; other columns are not read.
    """
    turns = conversations.select("conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    placed = placed_turns(turns)
    return render(placed, maximal_conversations(placed), part_turns)
