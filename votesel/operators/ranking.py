"""Exact ranks and running sums over groups that may be arbitrarily large.

``row_number() over (partition by g order by k)`` puts a whole group ``g`` into
one task. A class (or one partition of a feature) can hold a third of all rows,
so instead every row also gets an order-preserving *bucket* inside its group:

1. count (or sum) per ``(g, bucket)``      -- partial + final aggregate, tiny output
2. exclusive prefix over the buckets of g  -- window over the tiny table
3. rank / running sum inside ``(g, bucket)`` plus that offset

The result equals the plain window exactly, and no task holds more than one
bucket of one group. Bucket counts are picked from the measured largest group
so that a bucket stays under ``rows_per_task`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votesel.functions.exprs import hex_bucket

# Largest number of rows one window task should see.
ROWS_PER_TASK = 2_000_000
# A side is broadcast only when its counted size is at most this many rows.
BROADCAST_MAX_ROWS = 2_000_000
# Rows that one task sorts after a shuffle.
ROWS_PER_SORT = 1_000_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
# Rows in memory are taken as so many times the size of their compressed files.
UNPACKED = 4


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only after counting it: at most ``max_rows`` rows and an estimated
    ``max_bytes`` (rows x the schema's default row size, or ``UNPACKED`` times the written files if that
    is more: the default counts one element per array). Otherwise it stays a shuffle join.

    The side is written once as a table (not cached), so it is computed a single time and
    adds no cache entry that every later query would have to be matched against."""
    from votesel.session import cut_lineage

    df = cut_lineage(df)
    n = df.count()
    row_bytes = max(int(df._jdf.schema().defaultSize()), 8)
    file_bytes = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    small = n <= max_rows and max(n * row_bytes, UNPACKED * file_bytes) <= max_bytes
    return F.broadcast(df) if small else df


def join_few(rows: DataFrame, few: DataFrame, on: Sequence[str]) -> DataFrame:
    """``rows`` inner joined on ``on`` with a table small enough to be broadcast.

    One number, a hash of the columns, is looked up per row and the columns are compared on a match: cheaper for
    many rows than looking up several columns."""
    held = few.select(F.xxhash64(*on).alias("_k2"), *[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in few.columns if c not in on])
    same = F.lit(True)
    for c in on:
        same = same & (F.col(c) == F.col(f"_on_{c}"))
    found = (F.col("_k") == F.col("_k2")) & F.when(same, True).otherwise(False)
    return rows.withColumn("_k", F.xxhash64(*on)).join(F.broadcast(held), found).drop("_k", "_k2", *[f"_on_{c}" for c in on])


def sort_tasks(df: DataFrame, rows: int) -> list[int]:
    """The number of tasks that sort ``rows`` rows, if the session's number of shuffle partitions is too small."""
    tasks = math.ceil(rows / ROWS_PER_SORT)
    return [tasks] if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []


def hex_digits_for(max_group_rows: int, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Hex digits of an md5 prefix so that one (group, bucket) stays under ``rows_per_task``."""
    if max_group_rows <= rows_per_task:
        return 0
    return max(1, math.ceil(math.log(max_group_rows / rows_per_task, 16)))


def bucket_offsets(df: DataFrame, keys: list[str], sum_cols: Sequence[str]) -> DataFrame:
    """Per (keys, _bkt): exclusive prefix sums of ``sum_cols`` over the buckets of each group."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.sum(c).alias(f"_s_{c}") for c in sum_cols]
    totals = df.groupBy(*keys, "_bkt").agg(*aggs)
    w = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    out = totals.select(
        *keys,
        "_bkt",
        F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off_n"),
        *[F.coalesce(F.sum(f"_s_{c}").over(w), F.lit(0)).alias(f"_off_{c}") for c in sum_cols],
    )
    return out


def exact_row_number(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column | None,
    out: str = "rn",
    offsets: DataFrame | None = None,
    rows: int = 0,
) -> DataFrame:
    """Add ``out`` = row_number() over (partition by keys order by order), bucketed.

    ``bucket`` must be non-decreasing in ``order`` inside each group (``None`` = one bucket). ``offsets``: as of
    ``bucket_offsets``, if known; ``rows``: how many there are, if known.
    """
    keys = list(keys)
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, F.row_number().over(w))
    b = df.withColumn("_bkt", bucket)
    offsets = checked_broadcast(bucket_offsets(b, keys, []) if offsets is None else offsets)
    w = Window.partitionBy(*keys, "_bkt").orderBy(*order)
    many = sort_tasks(df, rows)
    if many:
        b = b.repartition(*many, *keys, "_bkt")
    return (
        b.join(offsets, [*keys, "_bkt"])
        .withColumn(out, F.row_number().over(w) + F.col("_off_n"))
        .drop("_bkt", "_off_n")
    )


def exact_running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sum_cols: Sequence[str],
    bucket: Column | None,
    prefix: str = "cum_",
    position: str | None = None,
) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` (and optionally the row position) in ``order``.

    The order must be total inside each group (ties would make the running sums arbitrary).
    """
    keys = list(keys)
    frame = Window.unboundedPreceding, Window.currentRow
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*frame)
        cols = [F.sum(c).over(w).alias(prefix + c) for c in sum_cols]
        if position:
            cols.append(F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias(position))
        return df.select("*", *cols)
    b = df.withColumn("_bkt", bucket)
    offsets = checked_broadcast(bucket_offsets(b, keys, sum_cols))
    w = Window.partitionBy(*keys, "_bkt").orderBy(*order).rowsBetween(*frame)
    joined = b.join(offsets, [*keys, "_bkt"])
    cols = [(F.sum(c).over(w) + F.col(f"_off_{c}")).alias(prefix + c) for c in sum_cols]
    if position:
        wp = Window.partitionBy(*keys, "_bkt").orderBy(*order)
        cols.append((F.row_number().over(wp) + F.col("_off_n")).alias(position))
    drop = ["_bkt", "_off_n", *[f"_off_{c}" for c in sum_cols]]
    return joined.select("*", *cols).drop(*drop)


def md5_bucket(h: Column, max_group_rows: int, rows_per_task: int = ROWS_PER_TASK) -> Column | None:
    """Bucket for an md5-hex order key, or None when a group fits one task."""
    d = hex_digits_for(max_group_rows, rows_per_task)
    return hex_bucket(h, d) if d else None


def quantile_bucket(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    max_group_rows: int,
    rows_per_task: int = ROWS_PER_TASK,
) -> tuple[DataFrame, Column | None]:
    """Order-preserving bucket of a numeric ``value`` from approximate per-group quantiles.

    Returns the frame with the quantile bounds attached and the bucket column
    (``None`` when every group fits one task). Approximate bounds only change
    bucket sizes, never the exact result.
    """
    n = math.ceil(max_group_rows / rows_per_task)
    if n <= 1:
        return df, None
    probs = [i / n for i in range(1, n)]
    bounds = df.groupBy(*keys).agg(F.percentile_approx(value, probs, 10 * n).alias("_bounds"))
    out = df.join(checked_broadcast(bounds), list(keys))
    bucket = F.size(F.filter(F.col("_bounds"), lambda b: b < F.col(value)))
    return out, bucket
