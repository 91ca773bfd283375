"""What changed between consecutive full snapshots, by Merkle trees over hash ranges.

Each snapshot of a repo becomes a tree: a key's 64-bit hash picks its leaf range,
``fanout_bits`` of the hash are dropped per level towards the root, and a node's
digest is made of the digests below it. Two consecutive snapshots are compared top-down:
only children of differing nodes are looked at, and only rows of differing leaves
are joined and compared one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from hearthdex.functions.paths import clean_path, packed_digest

#: Bits between a level and the next, rows that a leaf of the largest snapshot should have, and bits of a leaf at most.
FANOUT_BITS = 8
LEAF_ROWS = 32
MOST_BITS = 48


def consecutive(snapshots: DataFrame) -> DataFrame:
    """``repo, no, prev_no, next_no`` of the complete snapshots of each repo.

    Partial and failed snapshots are skipped: the one before a complete snapshot
    is the last complete one. Rows come twice without harm; null keys are ignored.
    """
    done = (
        snapshots.where(F.lower(F.trim("status")) == "complete")
        .select(F.col("repo"), F.col("snapshot_no").cast("int").alias("no"))
        .where(F.col("repo").isNotNull() & F.col("no").isNotNull())
        .distinct()
    )
    order = W.partitionBy("repo").orderBy("no")
    return done.withColumns({"prev_no": F.lag("no").over(order), "next_no": F.lead("no").over(order)})


def settled(states: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per (repo, snapshot, clean path): that with the latest ``loaded_at``.

    A latest row with a null hash means that the file is absent. Of rows equal in
    ``loaded_at`` the greatest digest counts; a null ``loaded_at`` is the oldest.
    """
    rows = states.select(
        F.col("repo"),
        F.col("snapshot_no").cast("int").alias("no"),
        clean_path(F.col("path")).alias("path"),
        F.col("loaded_at").alias("at"),
        packed_digest(F.col("hash")).alias("digest"),
    ).where("repo is not null and no is not null and path is not null")
    return (
        rows.join(pairs.select("repo", "no"), ["repo", "no"], "left_semi")
        .groupBy("repo", "no", "path")
        .agg(F.max(F.struct("at", "digest"))["digest"].alias("digest"))
        .where("digest is not null")
    )


def _sides(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each row once as the later and once as the earlier side of a pair; ``no`` becomes the pair's later number."""
    sided = df.join(pairs, ["repo", "no"]).select(
        df.columns[0],
        *[c for c in df.columns[2:]],
        F.explode(
            F.array(
                F.struct(F.when(F.col("prev_no").isNotNull(), F.col("no")).alias("no"), F.lit(True).alias("later")),
                F.struct(F.col("next_no").alias("no"), F.lit(False).alias("later")),
            )
        ).alias("side"),
    )
    return sided.select("*", "side.no", "side.later").drop("side").where("no is not null")


def leaf_bits_for(rows: int, fanout_bits: int = FANOUT_BITS) -> int:
    """Bits of the key hash that name a leaf, a multiple of ``fanout_bits``, for snapshots of up to ``rows`` rows."""
    leaves = max(1, rows // LEAF_ROWS)
    return min(max(1, -(-(leaves - 1).bit_length() // fanout_bits)) * fanout_bits, MOST_BITS // fanout_bits * fanout_bits)


def merkle_levels(rows: DataFrame, leaf_bits: int, fanout_bits: int = FANOUT_BITS) -> list[DataFrame]:
    """Node tables ``repo, no, node, n, d1, d2`` from the root level to the leaves."""
    level = (
        rows.groupBy("repo", "no", F.shiftrightunsigned(F.xxhash64("path"), 64 - leaf_bits).alias("node"))
        .agg(
            F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("path", "digest")).alias("d1"),
            F.bit_xor(F.xxhash64("digest", F.lit("second"), "path")).alias("d2"),
        )
    )
    levels, bits = [level], leaf_bits
    while bits > 0:
        step = min(fanout_bits, bits)
        bits -= step
        level = (
            level.groupBy("repo", "no", F.shiftrightunsigned("node", step).alias("node"))
            .agg(
                F.sum("n").alias("n"),
                F.bit_xor(F.xxhash64("node", "n", "d1", "d2")).alias("d1"),
                F.bit_xor(F.xxhash64("d2", "d1", "n", "node")).alias("d2"),
            )
        )
        levels.append(level)
    return levels[::-1]


def differing_leaves(levels: list[DataFrame], pairs: DataFrame, fanout_bits: int = FANOUT_BITS) -> DataFrame:
    """``repo, no, node`` of the leaves whose digests differ within a pair, found top-down."""
    unequal = None
    for level in levels:
        sided = _sides(level, pairs)
        if unequal is not None:
            parents = unequal.select("repo", "no", F.col("node").alias("parent"))
            sided = (
                sided.withColumn("parent", F.shiftrightunsigned("node", fanout_bits))
                .join(parents, ["repo", "no", "parent"], "left_semi")
                .drop("parent")
            )
        one = lambda c, side: F.max(F.when(F.col("later") == side, F.col(c)))
        unequal = (
            sided.groupBy("repo", "no", "node")
            .agg(*[one(c, s).alias(f"{c}_{s}") for c in ("n", "d1", "d2") for s in (True, False)])
            .where(" or ".join(f"not ({c}_True <=> {c}_False)" for c in ("n", "d1", "d2")))
            .select("repo", "no", "node")
        )
    return unequal


def snapshot_changes(states: DataFrame, snapshots: DataFrame, leaf_bits: int | None = None, fanout_bits: int = FANOUT_BITS) -> DataFrame:
    """``repo, snapshot_no, path, kind`` of each change between consecutive complete snapshots.

    ``states`` has ``repo, snapshot_no, path, hash, loaded_at`` and ``snapshots`` has
    ``repo, snapshot_no, status``; further columns are ignored. ``kind`` is added,
    removed or changed; a move is one removed and one added path. A repo's first
    complete snapshot has no rows; a complete snapshot without states means that
    all files are gone. Rows with a null repo, number or path are ignored, empty
    tables give an empty result. ``leaf_bits`` must be a multiple of ``fanout_bits``;
    without it the rows of the largest snapshot give it, so leaves are far fewer than rows.
    """
    if leaf_bits is None:
        most = states.groupBy("repo", "snapshot_no").count().agg(F.max("count")).first()[0]
        leaf_bits = leaf_bits_for(most or 0, fanout_bits)
    if leaf_bits % fanout_bits or not 0 < leaf_bits <= 48:
        raise ValueError("leaf_bits must be a positive multiple of fanout_bits, 48 at most")
    pairs = consecutive(snapshots)
    rows = settled(states, pairs)
    leaves = differing_leaves(merkle_levels(rows, leaf_bits, fanout_bits), pairs, fanout_bits)
    suspects = _sides(rows, pairs).withColumn("node", F.shiftrightunsigned(F.xxhash64("path"), 64 - leaf_bits))
    return (
        suspects.join(leaves, ["repo", "no", "node"], "left_semi")
        .groupBy("repo", "no", "path")
        .agg(
            F.max(F.when(F.col("later"), F.col("digest"))).alias("now"),
            F.max(F.when(~F.col("later"), F.col("digest"))).alias("before"),
        )
        .where("not (now <=> before)")
        .select(
            "repo",
            F.col("no").alias("snapshot_no"),
            "path",
            F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("kind"),
        )
    )
