"""Supervised discretization (Fayyad & Irani 1993, MDL stop) on value histograms.

Input is the long numeric cells of one or many *scopes* (a scope is a
``(round, part)`` block, or the whole table). Nothing is done per row:

* histogram: one record per (scope, feature, distinct value) with one count
  column per class (partial + final aggregate, so a hot value is one record);
* running class counts in value order (``exact_running_sums``: bucketed, so a
  feature with a huge number of distinct values is still spread over tasks);
* one Spark job per tree level for *all* scopes and features at once: each open
  interval (a node, named by its left end: open intervals never overlap) finds its best
  boundary with ``min_by`` over its candidates, applies the MDL test, and the
  accepted ones split. The loop ends when no interval splits.

A boundary "after value v" sends ``x <= v`` left. The boundary with the lowest
class-conditional entropy wins, the lowest value on ties (entropies compared
after rounding to 12 decimals so both engines agree).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votesel.operators.ranking import (
    BROADCAST_MAX_ROWS,
    ROWS_PER_TASK,
    checked_broadcast,
    exact_running_sums,
    join_few,
    quantile_bucket,
    sort_tasks,
)
from votesel.session import cut_lineage, drop_tables, loop_state, materialize

TIE_DIGITS = 12
# With more boundaries than so many, those near the lowest entropy are looked up by runs of so many positions.
ROWS_PER_LEVEL = 1_000_000
RUN = 4096


def class_list(df: DataFrame, label: str = "class") -> list[str]:
    """Sorted class labels (the label domain is small; the reference broadcasts it too)."""
    return sorted(r[0] for r in df.select(label).distinct().collect())


def value_histogram(cells: DataFrame, keys: Sequence[str], classes: Sequence[str], value: str = "num") -> DataFrame:
    """``keys, value, n0..n{k-1}`` from cells carrying ``keys, value, class``."""
    aggs = [F.count_if(F.col("class") == F.lit(c)).alias(f"n{i}") for i, c in enumerate(classes)]
    return cells.groupBy(*keys, F.col(value).alias("value")).agg(*aggs)


def _xl(c: str) -> str:
    """SQL text of c*log2(c), 0 for c = 0 (expressions are built as SQL text: one JVM call each)."""
    return f"(CASE WHEN ({c}) > 0 THEN ({c}) * log2({c}) ELSE 0.0 END)"


def _plus(cols: Sequence[str]) -> str:
    return "(" + " + ".join(cols) + ")"


def _npos(cols: Sequence[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} > 0 THEN 1 ELSE 0 END" for c in cols) + ")"


def mdl_candidates(cum: DataFrame, intervals: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Every boundary inside an open interval with its class-conditional entropy ``e`` (bits).

    ``e = (nL log2 nL + nR log2 nR - sum l log2 l - sum r log2 r) / n``.
    """
    return candidates_from(cum.join(intervals, [*keys, "node"]), keys, k)


def candidates_from(rows: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Boundaries of histogram rows that carry their interval (``node, lo_d, hi_d, lo*, hi*``)."""
    j = rows.where(F.col("dpos") < F.col("hi_d"))
    ls = [f"l{i}" for i in range(k)]
    rs = [f"r{i}" for i in range(k)]
    lr = j.selectExpr(
        *keys,
        "node",
        "value",
        "dpos",
        "lo_d",
        "hi_d",
        *[f"lo{i}" for i in range(k)],
        *[f"cn{i} - lo{i} AS l{i}" for i in range(k)],
        *[f"hi{i} - cn{i} AS r{i}" for i in range(k)],
    )
    lr = lr.selectExpr("*", f"{_plus(ls)} AS nl", f"{_plus(rs)} AS nr")
    e = f"({_xl('nl')} + {_xl('nr')} - {_plus([_xl(c) for c in ls])} - {_plus([_xl(c) for c in rs])}) / (nl + nr)"
    return lr.selectExpr("*", f"{e} AS e")


def boundary_fields(k: int) -> list[str]:
    """What a boundary is chosen and split by."""
    return ["value", "dpos", "e", "lo_d", "hi_d", "nl", "nr"] + [f"{p}{i}" for p in ("l", "r", "lo") for i in range(k)]


def mdl_best(
    cands: DataFrame, keys: Sequence[str], k: int, better_encoding: bool = True, intervals: int | None = None
) -> DataFrame:
    """Best boundary per open interval and whether the MDL criterion accepts it.

    Accept iff ``e < H(S)`` and ``H(S) - e > (log2(C) + log2(3^k - 2) - k H(S) + k1 H1 + k2 H2) / n``
    with C the number of candidate boundaries (distinct values - 1 with the better
    encoding, n - 1 otherwise). ``intervals``: how many are open at most, if known.
    """
    fields = boundary_fields(k)
    # the lowest entropy is a number, so a hash aggregate finds it; only rows that may round to it are rounded and sorted
    low = cands.groupBy(*keys, "node").agg(F.min("e").alias("_low"))
    if intervals is not None and intervals <= BROADCAST_MAX_ROWS:
        low = F.broadcast(low)
    near = cands.join(low, [*keys, "node"]).where(F.col("e") <= F.col("_low") + 2 * 10.0**-TIE_DIGITS)
    best = near.groupBy(*keys, "node").agg(
        F.expr(f"min_by(struct({', '.join(fields)}), struct(round(e, {TIE_DIGITS}), value))").alias("b")
    )
    best = best.selectExpr(*keys, "node", *[f"b.{f} AS {f}" for f in fields])
    ls = [f"l{i}" for i in range(k)]
    rs = [f"r{i}" for i in range(k)]
    ts = [f"(l{i} + r{i})" for i in range(k)]
    best = best.selectExpr(
        "*",
        "nl + nr AS n",
        f"(({_xl('nl')} - {_plus([_xl(c) for c in ls])}) / nl) AS h_l",
        f"(({_xl('nr')} - {_plus([_xl(c) for c in rs])}) / nr) AS h_r",
        f"(({_xl('nl + nr')} - {_plus([_xl(c) for c in ts])}) / (nl + nr)) AS h_prior",
        f"{_npos(ts)} AS k_all",
        f"{_npos(ls)} AS k_l",
        f"{_npos(rs)} AS k_r",
    )
    cut_points = "(hi_d - lo_d - 1)" if better_encoding else "(n - 1)"
    delta = "(log2(pow(3.0, k_all) - 2) - (k_all * h_prior - k_r * h_r - k_l * h_l))"
    accept = (
        f"(round(e, {TIE_DIGITS}) < round(h_prior, {TIE_DIGITS}) AND (h_prior - e) > (log2({cut_points}) + {delta}) / n)"
    )
    return best.selectExpr(
        *keys,
        "node",
        "value AS cut",
        "dpos",
        "e",
        "h_prior",
        "h_prior - e AS gain",
        "CAST(n AS BIGINT) AS n",
        f"{accept} AS accepted",
        *[f"{p}{i}" for p in ("l", "r", "lo") for i in range(k)],
        "lo_d",
        "hi_d",
    )


def prepare_histogram(hist: DataFrame, keys: Sequence[str], k: int, rows_per_task: int = ROWS_PER_TASK):
    """Running class counts ``cn*`` and distinct position ``dpos`` per (keys) in value order,
    plus the root interval of every group."""
    hist = materialize(hist)
    sizes = hist.groupBy(*keys).count()
    biggest = sizes.agg(F.max("count")).first()[0] or 0
    hb, bucket = quantile_bucket(hist, keys, "value", biggest, rows_per_task)
    counts = [f"n{i}" for i in range(k)]
    cum = exact_running_sums(hb, keys, [F.col("value")], counts, bucket, prefix="c", position="dpos")
    cum = cum.selectExpr(*keys, "value", "CAST(dpos AS BIGINT) AS dpos", *counts, *[f"cn{i}" for i in range(k)], "CAST(0 AS BIGINT) AS node")
    roots = hist.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hi_d"), *[F.sum(f"n{i}").alias(f"hi{i}") for i in range(k)]
    )
    roots = roots.selectExpr(*keys, *_root_columns(k))
    return materialize(cum), roots


def running_counts(
    cells: DataFrame,
    keys: Sequence[str],
    classes: Sequence[str],
    rows: int,
    buckets: int,
    spans: dict[str, tuple[int, int]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """As ``prepare_histogram``, from the cells ``keys, _bkt, value, cls`` (class index) of features of many values.

    Most values are rare there, so counting them before a shuffle saves nothing: the cells are shuffled once by
    ``(keys, _bkt)`` (a range of values) and counted, sorted and summed in place, then written once; what the lower
    ranges hold is added on reading. ``rows``: how many cells there are about. ``spans``: least value and number of
    values of every key, if those are integers; keys and range then travel as the digits of one number.
    """
    keys = list(keys)
    k = len(classes)
    counts = [f"n{i}" for i in range(k)]
    groups, back = [*keys, "_bkt"], [*keys, "_bkt"]
    if spans is not None:
        spans = {**spans, "_bkt": (0, buckets)}
        packed, radix, back = F.lit(0).cast("bigint"), 1, []
        for c in groups:
            low, size = spans[c]
            packed = packed + (F.col(c) - F.lit(low)) * F.lit(radix).cast("bigint")
            back.append(f"CAST((_g DIV {radix}L) % {size}L + {low} AS {dict(cells.dtypes)[c]}) AS {c}")
            radix *= size
        if radix < 2**62:
            cells, groups = cells.select(packed.alias("_g"), "value", "cls"), ["_g"]
        else:
            back = groups
    placed = cells.repartition(*sort_tasks(cells, rows), *groups)
    hist = placed.groupBy(*groups, "value").agg(*[F.count_if(F.col("cls") == i).alias(c) for i, c in enumerate(counts)])
    w = Window.partitionBy(*groups).orderBy("value")
    up_to = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = materialize(hist.select("*", *[F.sum(c).over(up_to).alias(f"c{c}") for c in counts], F.row_number().over(w).cast("bigint").alias("dpos")))
    sums = ["dpos", *[f"c{c}" for c in counts]]
    ends = materialize(cum.groupBy(*groups).agg(*[F.max(c).alias(c) for c in sums])).selectExpr(*groups, *[b for b in back if b not in groups], *sums)
    if buckets > 1:
        below = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
        offsets = ends.select(*groups, *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"_{c}") for c in sums])
        cum = cum.join(checked_broadcast(offsets), groups).withColumns({c: F.col(c) + F.col(f"_{c}") for c in sums})
    cum = cum.selectExpr(*back, "value", "dpos", *counts, *[f"cn{i}" for i in range(k)], "CAST(0 AS BIGINT) AS node").drop("_bkt")
    roots = ends.groupBy(*keys).agg(F.sum("dpos").alias("hi_d"), *[F.sum(f"cn{i}").alias(f"hi{i}") for i in range(k)])
    return cum, roots.selectExpr(*keys, *_root_columns(k))


def _root_columns(k: int) -> list[str]:
    return [
        "CAST(0 AS BIGINT) AS node",
        "CAST(0 AS BIGINT) AS lo_d",
        "CAST(hi_d AS BIGINT) AS hi_d",
        *[f"CAST(0 AS BIGINT) AS lo{i}" for i in range(k)],
        *[f"CAST(hi{i} AS BIGINT) AS hi{i}" for i in range(k)],
    ]


def mdl_discretize(
    hist: DataFrame,
    keys: Sequence[str],
    k: int,
    better_encoding: bool = True,
    max_depth: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> tuple[DataFrame, DataFrame]:
    """Recursive MDL splitting of every (keys) group of a histogram.

    Returns ``(coded, cuts)``: ``coded`` = ``keys, value, n*, code`` (code = number of
    accepted cuts below the value, 0-based interval index) and ``cuts`` =
    ``keys, cut, depth`` (accepted boundaries; ``x <= cut`` lies left of it).
    """
    cum, roots = prepare_histogram(hist, list(keys), k, rows_per_task)
    return mdl_levels(cum, roots, keys, k, better_encoding, max_depth)


def near_lowest(rows: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The open rows whose run of ``RUN`` positions holds (nearly) the lowest entropy of their interval.

    The entropy of every boundary is computed once, for the lowest per run: the best boundaries are then found
    among the few runs left, without a second look at all."""
    keys = [*keys, "node"]
    run = F.expr(f"dpos DIV {RUN}").alias("_run")
    lows = materialize(candidates_from(rows, keys[:-1], k).groupBy(*keys, run).agg(F.min("e").alias("_low")))
    least = lows.groupBy(*keys).agg(F.min("_low").alias("_least"))
    near = materialize(lows.join(least, keys).where(F.col("_low") <= F.col("_least") + 2 * 10.0**-TIE_DIGITS).select(*keys, "_run"))
    rows = rows.withColumn("_run", run)
    few = near.count() <= BROADCAST_MAX_ROWS
    return materialize((join_few(rows, near, [*keys, "_run"]) if few else rows.join(near, [*keys, "_run"])).drop("_run"))


def _with_intervals(rows: DataFrame, intervals: DataFrame, on: Sequence[str], n: int) -> DataFrame:
    """The rows of ``n`` intervals with what the intervals hold."""
    return join_few(rows, intervals, on) if n <= BROADCAST_MAX_ROWS else rows.join(intervals, list(on))


def mdl_cuts(
    cum: DataFrame,
    roots: DataFrame,
    keys: Sequence[str],
    k: int,
    better_encoding: bool = True,
    max_depth: int | None = None,
    rows_per_level: int = ROWS_PER_LEVEL,
) -> DataFrame:
    """``keys, cut, depth`` of the accepted boundaries and ``cn*``, the class counts up to them, from running class
    counts and root intervals."""
    keys = list(keys)
    spark = cum.sparkSession
    cut_parts, tables = [], []
    before, level = [], []  # the rows of the last level, those of the next
    depth = 0
    # every open row carries its interval bounds, so a level is one aggregate + one join
    roots = cut_lineage(roots)
    n_open, n_rows = roots.agg(F.count(F.lit(1)), F.coalesce(F.sum("hi_d"), F.lit(0))).first()
    active = _with_intervals(cum, roots, [*keys, "node"], n_open)
    counts = [f"n{i}" for i in range(k)] + [f"cn{i}" for i in range(k)]
    while True:
        depth += 1
        if max_depth is not None and depth > max_depth:
            break
        near = near_lowest(active, keys, k) if n_rows > rows_per_level else active
        # written: joined with their own lowest entropy as a plan, the optimizer rewrites the entropy's terms with every
        # alias per class, which doubles with each and fills the driver at ten classes
        found: list = []
        cands = cut_lineage(candidates_from(near, keys, k).select(*keys, "node", *boundary_fields(k)), found)
        best = mdl_best(cands, keys, k, better_encoding, n_open)
        acc = cut_lineage(best.where("accepted"), tables)
        drop_tables(spark, found)
        n_acc, n_rows = acc.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("hi_d") - F.col("lo_d")), F.lit(0))).first()
        if n_acc == 0:
            break
        n_open = 2 * n_acc
        cut_parts.append(acc.selectExpr(*keys, "cut", f"{depth} AS depth", *[f"lo{i} + l{i} AS cn{i}" for i in range(k)]))
        split = acc.selectExpr(*keys, "node", "dpos AS _cd", *[f"l{i} AS _l{i}" for i in range(k)])
        right = "(dpos > _cd)"
        active = loop_state(
            _with_intervals(active, split, [*keys, "node"], n_acc).selectExpr(
                *keys,
                "value",
                "dpos",
                *counts,
                f"CASE WHEN {right} THEN CAST(_cd AS BIGINT) ELSE node END AS node",
                f"CASE WHEN {right} THEN _cd ELSE lo_d END AS lo_d",
                f"CASE WHEN {right} THEN hi_d ELSE _cd END AS hi_d",
                *[f"CASE WHEN {right} THEN lo{i} + _l{i} ELSE lo{i} END AS lo{i}" for i in range(k)],
                *[f"CASE WHEN {right} THEN hi{i} ELSE lo{i} + _l{i} END AS hi{i}" for i in range(k)],
            ),
            depth,
            level,
        )
        drop_tables(spark, before)
        before, level = level, []
    if cut_parts:
        cuts = cut_parts[0]
        for c in cut_parts[1:]:
            cuts = cuts.unionByName(c)
    else:
        cuts = spark.createDataFrame([], cum.select(*keys, *[f"cn{i}" for i in range(k)]).schema).select(
            *keys, F.lit(None).cast("double").alias("cut"), F.lit(None).cast("int").alias("depth"), *[f"cn{i}" for i in range(k)]
        )
    cuts = cut_lineage(cuts)  # independent of the accepted rows and level tables, which can now go
    drop_tables(spark, tables + before)
    return cuts


def mdl_levels(
    cum: DataFrame, roots: DataFrame, keys: Sequence[str], k: int, better_encoding: bool = True, max_depth: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``mdl_discretize`` from running class counts and root intervals."""
    keys = list(keys)
    cuts = mdl_cuts(cum, roots, keys, k, better_encoding, max_depth).select(*keys, "cut", "depth")
    cut_sets = cuts.groupBy(*keys).agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    coded = cum.join(checked_broadcast(cut_sets), keys, "left").select(
        *keys,
        "value",
        *[f"n{i}" for i in range(k)],
        F.coalesce(F.size(F.filter(F.col("cuts"), lambda c: F.col("value") > c)), F.lit(0)).alias("code"),
    )
    return coded, cuts


def interval_counts(cuts: DataFrame, roots: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """``keys, code, n*``: class counts of the intervals between the cuts of ``mdl_cuts``, without reading the histogram."""
    keys = list(keys)
    ends = roots.selectExpr(*keys, "CAST(NULL AS DOUBLE) AS cut", *[f"hi{i} AS cn{i}" for i in range(k)])
    w = Window.partitionBy(*keys).orderBy(F.col("cut").asc_nulls_last())
    steps = cuts.select(*keys, "cut", *[f"cn{i}" for i in range(k)]).unionByName(ends)
    here = [(F.col(f"cn{i}") - F.coalesce(F.lag(f"cn{i}").over(w), F.lit(0))).alias(f"n{i}") for i in range(k)]
    return steps.select(*keys, (F.row_number().over(w) - 1).alias("code"), *here)


def code_of(x: Column, cuts: Column) -> Column:
    """0-based interval index of ``x`` given sorted boundaries (``x <= cut`` is left)."""
    return F.coalesce(F.size(F.filter(cuts, lambda c: x > c)), F.lit(0))
