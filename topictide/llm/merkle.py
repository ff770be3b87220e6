"""A Merkle manifest of documents: a tree for each source, and one tree over their roots.

A node is labelled by its tree and the interval [lo, hi) of leaf ranks that it covers.
Levels are buckets: what lies below a node of level l has lo div 16^l in common, so a run
meets its ancestor by an equality join on tree and bucket, and containment of the intervals
decides. Of a parent's interval, what is left without a node's own names its siblings: those
that end before it and those that begin after it. Paths are handed down from the root, and
carried once for a run of 16 leaves; the digests of a leaf are taken inside its run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topictide.llm.store import saved
from topictide.operators.numbering import numbered

#: Children of a node.
FANOUT = 16
#: Of ids whose CRC-32 this divides, the text is tampered with.
TAMPERED = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIDES = "array<struct<before:string,after:string>>"


def _hashed(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """H of the values: each ``-`` if null, else the number of its UTF-8 bytes, a colon, and it."""
    return _hashed(F.concat(*map(_field, values)))


def _hex(members: Column) -> Column:
    return F.array_join(F.transform(members, lambda m: m["hash"]), "")


def _bucket(level: int) -> Column:
    return F.expr(f"lo div {FANOUT**level}L").alias("bucket")


def _runs(nodes: DataFrame, level: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """Runs of a level's nodes, 16 ranks wide: tree, size, bucket, and members by interval."""
    members = F.array_sort(F.collect_list(F.struct("lo", "hi", "hash", *carried))).alias("members")
    open_trees = nodes.where(F.col("size") > FANOUT**level)
    return open_trees.groupBy("tree", "size", _bucket(level + 1)).agg(members)


def _levels(leaves: DataFrame, carried: tuple[str, ...] = ()) -> list[tuple[DataFrame, DataFrame]]:
    """(nodes, their runs) of each level. A tree of ``size`` leaves ends at the first level of as many ranks."""
    largest = leaves.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    levels, nodes, level = [], leaves, 0
    while True:
        runs = _runs(nodes, level, carried)
        if FANOUT**level >= largest:
            return [*levels, (nodes, runs)]
        runs = saved(runs) if level == 0 else runs
        levels.append((nodes, runs))
        covered = F.get("members", F.lit(0))["lo"].alias("lo"), F.element_at("members", -1)["hi"].alias("hi")
        nodes = saved(runs.select("tree", "size", *covered, _hashed(_hex(F.col("members"))).alias("hash")))
        level, carried = level + 1, ()


def _tops(levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """tree and hash of each tree's last node."""
    ended = [nodes.where(F.col("size") <= FANOUT**level).select("tree", "hash") for level, (nodes, _) in enumerate(levels)]
    tops = ended[0]
    for more in ended[1:]:
        tops = tops.unionByName(more)
    return tops


def _side(members: Column, keep) -> Column:
    return F.array_join(F.transform(F.filter(members, keep), lambda m: m["hash"]), "")


def _siblings(node: Column, members: Column) -> Column:
    """The parent's interval without the node's: hex of what ends before it and of what begins after it."""
    before = _side(members, lambda m: m["hi"] <= node["lo"])
    after = _side(members, lambda m: m["lo"] >= node["hi"])
    return F.struct(before.alias("before"), after.alias("after"))


def _with_paths(levels: list[tuple[DataFrame, DataFrame]], tops: DataFrame, carried: tuple[str, ...], members: tuple[str, ...] = ()) -> DataFrame:
    """Runs of leaves with ``path``, the siblings of their parent and of each ancestor, lowest first.

    ``tops`` has, for each tree, the path above its last node and the ``carried`` columns.
    Trees of one leaf have no run: their leaf comes alone, with ``run`` false.
    """
    reached = None
    for level in range(len(levels) - 1, -1, -1):
        nodes, runs = levels[level]
        ended = nodes.where(F.col("size") <= FANOUT**level).join(tops, "tree")
        if reached is not None:
            above = reached.select("tree", _bucket(level + 1), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "path", *carried)
            inside = (F.get("members", F.lit(0))["lo"] >= F.col("_lo")) & (F.element_at("members", -1)["hi"] <= F.col("_hi"))
            met = runs.join(above, ["tree", "bucket"]).where(inside).select("tree", "members", "path", *carried)
        if level > 0:
            paths = ended.select("tree", "lo", "hi", "path", *carried)
            if reached is not None:
                each = met.select("*", F.explode("members").alias("m"))
                path = F.concat(F.array(_siblings(F.col("m"), F.col("members"))), F.col("path"))
                paths = paths.unionByName(each.select("tree", F.col("m.lo").alias("lo"), F.col("m.hi").alias("hi"), path.alias("path"), *carried))
            reached = saved(paths)
    alone = F.array(F.struct("lo", "hi", "hash", *members)).alias("members")
    single = ended.select("tree", alone, "path", *carried, F.lit(False).alias("run"))
    return single if reached is None else single.unionByName(met.withColumn("run", F.lit(True)))


def _manifest_rows(rows: DataFrame) -> DataFrame:
    """One row for each leaf of the runs: digests of its siblings, and the root folded from its own."""
    upper = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    fold = lambda h, s: _hashed(F.concat(s["before"], h, s["after"]))
    each = rows.select("subroot", "root", "path", "run", "members", upper.alias("upper"), F.explode("members").alias("m"))
    sides = each.select("subroot", "root", "path", "run", "upper", "m", _siblings(F.col("m"), F.col("members")).alias("s"))
    start = F.coalesce(F.col("m.tampered"), F.col("m.hash"))
    folded = F.aggregate("path", F.when(F.col("run"), fold(start, F.col("s"))).otherwise(start), fold)
    proof = _hashed(F.concat("s.before", "s.after", "upper"))
    return sides.select(
        F.col("m.doc_id").alias("doc_id"), F.col("m.hash").alias("leaf"), "subroot", "root",
        proof.alias("proof_sha256"), folded.alias("folded_root"), (folded == F.col("root")).alias("verified"),
    )


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row.

    Nulls are written ``-``; a null source is a source of its own, the first; null ids come
    first in their source and are never tampered with. Repeated rows are leaves of their
    own; rows of one id are ordered by a digest of their columns. A lone leaf is its source's
    root, and the proof of a leaf without siblings is the digest of nothing. Empty tables
    give no rows; other columns are not read. Texts are hashed whole, in one pass.
    """
    values = [F.col(name) for name in ("doc_id", "source", "lang", "n_chars", "text")]
    other = leaf_digest(*values[:4], F.translate("text", UPPER, LOWER))
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPERED)) == 0
    hashed = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree"),
        leaf_digest(*values).alias("hash"), F.when(chosen, other).alias("tampered"),
    )
    ranked = numbered(saved(hashed), ["doc_id"], ["tree"], "hi", total="size")
    carried = ("doc_id", "tampered")
    leaves = ranked.withColumn("lo", F.col("hi") - 1)
    trees = _levels(leaves, carried)
    subroots = saved(_tops(trees))
    ordered = numbered(subroots, ["tree"], (), "hi", total="size")
    above = _levels(ordered.select(F.lit(0).alias("tree"), "size", (F.col("hi") - 1).alias("lo"), "hi", "hash", F.col("tree").alias("of")), ("of",))
    root = _tops(above).select("tree", F.col("hash").alias("root"), F.lit([]).cast(SIDES).alias("path"))
    met = _with_paths(above, root, ("root",), ("of",)).select("root", "path", "run", "members", F.explode("members").alias("m"))
    path = F.when(F.col("run"), F.concat(F.array(_siblings(F.col("m"), F.col("members"))), F.col("path"))).otherwise(F.col("path"))
    tops = saved(met.select(F.col("m.of").alias("tree"), F.col("m.hash").alias("subroot"), "root", path.alias("path")))
    return _manifest_rows(_with_paths(trees, tops, ("subroot", "root"), carried))
