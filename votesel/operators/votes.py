"""Removal votes: every (round, part) block votes against each feature it did not select.

``selected`` = ``round, part, idx`` (what each block's selector kept) and
``blocks`` = ``round, part`` (the blocks that exist). The block x feature table
is made with a generator (``explode(sequence(0, m-1))``), it is schema-sized
(rounds x parts x features), and the selected set is removed with an anti join.
In vertical mode a block also votes against features it never saw, exactly as
the reference diffs against all attributes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_sizes(selected: DataFrame, blocks: DataFrame) -> DataFrame:
    """``round, part, n_selected`` (0 for a block that kept nothing)."""
    n = selected.groupBy("round", "part").agg(F.count(F.lit(1)).alias("n_selected"))
    return blocks.join(n, ["round", "part"], "left").select(
        "round", "part", F.coalesce("n_selected", F.lit(0)).cast("bigint").alias("n_selected")
    )


def removed_records(selected: DataFrame, blocks: DataFrame, m: int) -> DataFrame:
    """``round, part, idx`` for every feature a block did not select."""
    all_pairs = blocks.select("round", "part", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("idx"))
    return all_pairs.join(selected.select("round", "part", "idx"), ["round", "part", "idx"], "left_anti")


def partition_votes(selected: DataFrame, blocks: DataFrame, attrs_df: DataFrame, rounds: int) -> DataFrame:
    """``round, idx, feature, votes``: per round, how many blocks removed the feature (dense)."""
    m = attrs_df.count()
    rem = removed_records(selected, blocks, m).groupBy("round", "idx").agg(F.count(F.lit(1)).alias("votes"))
    dense = attrs_df.select("idx", "feature").withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    return dense.join(rem, ["round", "idx"], "left").select(
        "round", "idx", "feature", F.coalesce("votes", F.lit(0)).cast("bigint").alias("votes")
    )


def vote_totals(round_votes: DataFrame) -> DataFrame:
    """``idx, feature, votes`` summed over rounds (features without votes have 0)."""
    return round_votes.groupBy("idx", "feature").agg(F.sum("votes").cast("bigint").alias("votes"))


def vote_stats(votes: DataFrame) -> DataFrame:
    """``n_voted, avg_votes, std_votes`` over features with at least one vote (population std)."""
    v = votes.where(F.col("votes") > 0)
    return v.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_voted"),
        F.coalesce(F.avg("votes"), F.lit(0.0)).alias("avg_votes"),
        F.coalesce(F.stddev_pop("votes"), F.lit(0.0)).alias("std_votes"),
    )


def zero_vote_features(votes: DataFrame) -> DataFrame:
    """Features no block voted against (always kept)."""
    return votes.where(F.col("votes") == 0).select("idx", "feature")


def part_stats(sizes: DataFrame) -> DataFrame:
    """Count, mean, population std, max and min of the selected-subset sizes over blocks."""
    return sizes.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_blocks"),
        F.avg("n_selected").alias("mean_selected"),
        F.stddev_pop("n_selected").alias("std_selected"),
        F.max("n_selected").cast("bigint").alias("max_selected"),
        F.min("n_selected").cast("bigint").alias("min_selected"),
    )


def cfs_mean_size(selected: DataFrame, blocks: DataFrame, m: int) -> DataFrame:
    """Reference bookkeeping for CFS: per (round, removed feature) the largest subset size
    (class counted) among the blocks that removed it; ``floor(avg)`` of those."""
    sizes = block_sizes(selected, blocks)
    rem = removed_records(selected, blocks, m).join(sizes, ["round", "part"])
    per = rem.groupBy("round", "idx").agg(F.max(F.col("n_selected") + 1).alias("max_n"))
    return per.agg(F.floor(F.avg("max_n")).cast("bigint").alias("cfs_mean_size"), F.count(F.lit(1)).cast("bigint").alias("n_records"))
