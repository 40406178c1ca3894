"""Feature selectors evaluated inside every (round, part) block at once.

A *scope* is the data a block's statistics come from: in horizontal mode the
block's own rows (scope = block), in vertical mode all training rows (one scope,
``round = part = 0``), the block only restricting which features it may pick.

* ``ig``: information gain of the MDL-coded feature with the class, Ranker top-k.
* ``cfs``: correlation-based subset search (Hall 1999): greedy forward selection
  on the merit ``sum r_cf / sqrt(k + 2 sum r_ff)`` with symmetrical uncertainty,
  then the locally-predictive step. Feature-feature correlations are computed on
  demand, one pass over the coded rows per step for *all* blocks (never all m^2
  pairs).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votesel.operators.attributes import NOMINAL, NUMERIC, Attr, column
from votesel.operators.discretize import code_of, running_counts
from votesel.operators.info import feature_class_contingency, info_gain, pair_measures, rank_top_k
from votesel.operators.ranking import checked_broadcast
from votesel.session import cut_lineage, drop_tables, loop_state, materialize

SCOPE = ["round", "part"]
DIGITS = 9
# Features whose sampled values repeat less than this often on average have many values ...
FEW_REPEATS = 20
SAMPLE_ROWS = 200_000
# ... in tables of so many rows; each has a range of values per so many training rows.
MANY_ROWS = 10_000
ROWS_PER_RANGE = 1_000_000
MOST_RANGES = 64
# Cut points that are compared one by one rather than by a function over their array.
MOST_UNROLLED = 32


class Blocks:
    """How rows and features map to (round, part) blocks."""

    def __init__(
        self,
        train: DataFrame,
        attrs: Sequence[Attr],
        assign: DataFrame | None = None,
        vpart: DataFrame | None = None,
        dealt: DataFrame | None = None,
        places: DataFrame | None = None,
    ):
        self.train = train
        self.attrs = list(attrs)
        self.assign = assign  # horizontal: round, part, row_id
        self.dealt = dealt  # horizontal: the same rows with round, part and without their ids
        self.places = places  # round, part of the dealt rows, if known
        self.vpart = vpart  # vertical: round, part, idx, feature, shared
        self.vertical = vpart is not None

    def scoped_rows(self) -> DataFrame:
        if self.vertical:
            return self.train.withColumn("round", F.lit(0)).withColumn("part", F.lit(0))
        return self.assign.join(self.train, "row_id")

    def values(self) -> DataFrame:
        """The scoped rows for consumers that need no row ids."""
        return self.scoped_rows() if self.dealt is None else self.dealt

    def cells(self, kind: str | None = None, without: Sequence[int] = ()) -> DataFrame:
        """``round, part, class, idx, num, cat`` of the features of one kind (default: all)."""
        own = [a for a in self.attrs if (kind is None or a.kind == kind) and a.idx not in without]
        return _melt_scoped(self.values(), own or self.attrs[:1])

    def blocks(self) -> DataFrame:
        if self.vertical:
            return self.vpart.select("round", "part").distinct()
        if self.places is not None:
            return self.places
        return (self.assign if self.dealt is None else self.dealt).select("round", "part").distinct()

    def value_ranges(self, most_rows: int = MANY_ROWS) -> tuple[dict[int, list[float]], int]:
        """Bounds of ranges of values for the numeric features of many values, and the training rows.

        Bounds and kind come from a bounded sample: they only place the cells in tasks, no count depends on them."""
        n = self.train.count()
        num = [a for a in self.attrs if a.kind == NUMERIC]
        if n < most_rows or not num:
            return {}, n
        part = self.train.sample(min(1.0, SAMPLE_ROWS / n), 7)
        ranges = max(1, min(MOST_RANGES, math.ceil(n / ROWS_PER_RANGE)))
        probs = [i / ranges for i in range(1, ranges)]
        found = [F.count(F.lit(1)).alias("n")]
        for i, a in enumerate(num):
            x = column(a.name).cast("double")
            found.append(F.approx_count_distinct(x).alias(f"d{i}"))
            if probs:
                found.append(F.percentile_approx(x, F.array(*map(F.lit, probs)), 1000).alias(f"q{i}"))
        row = part.agg(*found).first()
        return {
            a.idx: sorted({b for b in (row[f"q{i}"] or []) if b == b} if probs else []) for i, a in enumerate(num) if row[f"d{i}"] * FEW_REPEATS > row["n"]
        }, n

    def range_cells(self, bounds: dict[int, list[float]], classes: Sequence[str]) -> DataFrame:
        """``round, part, idx, _bkt, value, cls`` of the features with ``bounds``; ``cls`` is the class index."""
        cells = []
        for a in self.attrs:
            if a.idx in bounds:
                x = column(a.name).cast("double")
                at = F.lit(len(bounds[a.idx]))
                for i, b in reversed(list(enumerate(bounds[a.idx]))):
                    at = F.when(x <= F.lit(b), F.lit(i)).otherwise(at)
                cells.append(F.struct(F.lit(a.idx).alias("idx"), at.alias("_bkt"), x.alias("value")))
        cls = F.array_position(F.array(*map(F.lit, classes)), F.col("class")).cast("int") - 1
        return self.values().select("round", "part", cls.alias("cls"), F.inline(F.array(*cells))).where(F.col("value").isNotNull())

    def spans(self) -> dict[str, tuple[int, int]]:
        """Least value and number of values up to the greatest of the scopes' rounds and parts and the feature index."""
        row = (0, 0, 0, 0) if self.vertical else self.blocks().agg(*[f(c) for c in SCOPE for f in (F.min, F.max)]).first()
        least = min(a.idx for a in self.attrs)
        found = {c: (row[2 * i] or 0, (row[2 * i + 1] or 0) - (row[2 * i] or 0) + 1) for i, c in enumerate(SCOPE)}
        return {**found, "idx": (least, max(a.idx for a in self.attrs) - least + 1)}

    def block_features(self, per_scope: DataFrame) -> DataFrame:
        """Attach scope-level per-feature numbers to the blocks that may use the feature."""
        if self.vertical:
            glob = per_scope.drop("round", "part")
            return self.vpart.select("round", "part", "idx").join(glob, "idx")
        return per_scope


def _melt_scoped(rows: DataFrame, attrs: Sequence[Attr]) -> DataFrame:
    cells = [
        F.struct(
            F.lit(a.idx).alias("idx"),
            (column(a.name).cast("double") if a.kind == NUMERIC else F.lit(None).cast("double")).alias("num"),
            (F.lit(None).cast("string") if a.kind == NUMERIC else column(a.name).cast("string")).alias("cat"),
        )
        for a in attrs
    ]
    return rows.select("round", "part", "class", F.inline(F.array(*cells)))


def class_scores(bl: Blocks, classes: Sequence[str], better_encoding: bool = True, many_rows: int | None = None):
    """``round, part, idx, ig, su`` per scope and the accepted MDL cuts ``round, part, idx, cut, depth``."""
    bounds, n = bl.value_ranges() if many_rows is None else bl.value_ranges(many_rows)
    running = None
    if bounds:
        spans = bl.spans()
        cells = n * len(bounds) * spans["round"][1]
        most = max(map(len, bounds.values())) + 1
        running = running_counts(bl.range_cells(bounds, classes), [*SCOPE, "idx"], classes, cells, most, spans)
    few = bl.cells(NUMERIC, bounds)
    if all(a.kind != NUMERIC or a.idx in bounds for a in bl.attrs):
        few = few.where(F.lit(False))
    ct, cuts = feature_class_contingency(few, SCOPE, classes, better_encoding, bl.cells(NOMINAL), running)
    scores = materialize(info_gain(ct, SCOPE))
    return scores, cuts


def ig_select(bl: Blocks, classes: Sequence[str], k: int, scores: DataFrame | None = None) -> DataFrame:
    """``round, part, idx`` kept by the Ranker (top k by information gain) in every block."""
    if scores is None:
        scores, _ = class_scores(bl, classes)
    per_block = bl.block_features(scores.select(*SCOPE, "idx", F.col("ig").alias("score")))
    return rank_top_k(per_block, SCOPE, k).select(*SCOPE, "idx")


# ---------------------------------------------------------------- CFS


def coded_rows(bl: Blocks, cuts: DataFrame) -> DataFrame:
    """``round, part, codes array<string>, n``: the scoped rows as MDL interval indexes for numeric features and raw
    values for nominal ones (position = idx), equal ones counted. Codes are few, so rows shrink before any shuffle."""
    per_feat = cuts.groupBy(*SCOPE, "idx").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    per_feat = materialize(per_feat)
    most = {r["idx"]: r["m"] for r in per_feat.groupBy("idx").agg(F.max(F.size("cuts")).alias("m")).collect()}
    rows = bl.values()
    if most:
        held = [F.first(F.when(F.col("idx") == i, F.col("cuts")), ignorenulls=True).alias(f"_cuts{i}") for i in sorted(most)]
        rows = rows.join(checked_broadcast(per_feat.groupBy(*SCOPE).agg(*held)), SCOPE, "left")
    codes = []
    for a in sorted(bl.attrs, key=lambda a: a.idx):
        if a.kind == NUMERIC:
            code = _code(column(a.name).cast("double"), F.col(f"_cuts{a.idx}"), most[a.idx]) if a.idx in most else F.lit(0)
            codes.append(code.alias(f"_code{a.idx}"))
        else:
            codes.append(column(a.name).cast("string").alias(f"_code{a.idx}"))
    names = [f"_code{a.idx}" for a in sorted(bl.attrs, key=lambda a: a.idx)]
    counted = rows.select(*SCOPE, *codes).groupBy(*SCOPE, *names).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*SCOPE, F.array(*[F.col(c).cast("string") for c in names]).alias("codes"), "n")


def _code(x, cuts, most: int):
    if most > MOST_UNROLLED:
        return code_of(x, cuts)
    code = F.lit(0)
    for i in range(most):
        code = code + F.when(x > F.get(cuts, F.lit(i)), 1).otherwise(0)
    return code


def pair_su(coded: DataFrame, chosen: DataFrame) -> DataFrame:
    """``round, part, c, idx, su``: symmetrical uncertainty of every feature with each chosen
    feature ``c`` of its scope, from one pass over the counted codes (partial aggregation)."""
    j = coded.join(checked_broadcast(chosen.select(*SCOPE, "c").distinct()), SCOPE)
    ex = j.select(
        *SCOPE, "c", "n", F.element_at("codes", F.col("c") + 1).alias("code_c"), F.posexplode("codes").alias("idx", "code_f")
    )
    ct = ex.groupBy(*SCOPE, "c", "idx", "code_f", "code_c").agg(F.sum("n").alias("n"))
    return pair_measures(ct, [*SCOPE, "c", "idx"], "code_f", "code_c").select(*SCOPE, "c", "idx", "su")


def _to_scope(bl: Blocks, df: DataFrame) -> DataFrame:
    if bl.vertical:
        return df.withColumn("s_round", F.lit(0)).withColumn("s_part", F.lit(0))
    return df.withColumn("s_round", F.col("round")).withColumn("s_part", F.col("part"))


def _update_with(bl: Blocks, coded: DataFrame, cand: DataFrame, picks: DataFrame) -> DataFrame:
    """Mark ``picks`` (round, part, c) as chosen and fold SU(f, c) into acc_rff / max_rff."""
    sc = _to_scope(bl, picks).select(F.col("s_round").alias("round"), F.col("s_part").alias("part"), "c")
    su = pair_su(coded, sc)
    mapped = _to_scope(bl, picks).join(
        su.withColumnRenamed("round", "s_round").withColumnRenamed("part", "s_part"), ["s_round", "s_part", "c"]
    ).select(*SCOPE, "idx", F.col("su").alias("_su"), "c")
    upd = cand.join(mapped, [*SCOPE, "idx"], "left")
    return upd.select(
        *SCOPE,
        "idx",
        "rcf",
        (F.col("acc_rff") + F.coalesce("_su", F.lit(0.0))).alias("acc_rff"),
        F.greatest(F.col("max_rff"), F.coalesce("_su", F.lit(0.0))).alias("max_rff"),
        (F.col("chosen") | (F.col("idx") == F.coalesce(F.col("c"), F.lit(-1)))).alias("chosen"),
        F.when(F.col("idx") == F.coalesce(F.col("c"), F.lit(-1)), F.col("step_no")).otherwise(F.col("order_in")).alias("order_in"),
        "step_no",
    )


def cfs_select(
    bl: Blocks,
    classes: Sequence[str],
    scores: DataFrame,
    cuts: DataFrame,
    locally_predictive: bool = True,
    max_steps: int | None = None,
) -> DataFrame:
    """``round, part, idx, step`` kept by CFS in every block (step = order of addition)."""
    coded = materialize(coded_rows(bl, cuts))
    rcf = bl.block_features(scores.select(*SCOPE, "idx", F.col("su").alias("rcf")))
    cand = rcf.select(
        *SCOPE,
        "idx",
        "rcf",
        F.lit(0.0).alias("acc_rff"),
        F.lit(0.0).alias("max_rff"),
        F.lit(False).alias("chosen"),
        F.lit(None).cast("int").alias("order_in"),
        F.lit(0).alias("step_no"),
    )
    state = bl.blocks().select(
        *SCOPE, F.lit(0).alias("k"), F.lit(0.0).alias("sum_rcf"), F.lit(0.0).alias("sum_rff"), F.lit(0.0).alias("merit")
    )
    cand, state = materialize(cand), materialize(state)
    tables: list = []
    step = 0
    # greedy forward search
    while max_steps is None or step < max_steps:
        step += 1
        j = cand.where(~F.col("chosen")).join(state, SCOPE)
        merit = (F.col("sum_rcf") + F.col("rcf")) / F.sqrt(F.col("k") + 1 + 2 * (F.col("sum_rff") + F.col("acc_rff")))
        j = j.withColumn("m_new", merit)
        best = j.groupBy(*SCOPE).agg(
            F.max_by(F.struct("idx", "m_new", "rcf", "acc_rff"), F.struct(F.round("m_new", DIGITS), -F.col("idx"))).alias("b"),
            F.first("merit").alias("merit"),
        )
        best = best.where(F.round(F.col("b.m_new"), DIGITS) > F.round(F.col("merit"), DIGITS))
        picks = best.select(*SCOPE, F.col("b.idx").alias("c"), F.col("b.m_new").alias("m_new"), F.col("b.rcf").alias("b_rcf"), F.col("b.acc_rff").alias("b_acc"))
        picks = materialize(picks)
        if picks.isEmpty():
            break
        state = loop_state(
            state.join(picks, SCOPE, "left").select(
                *SCOPE,
                (F.col("k") + F.when(F.col("c").isNotNull(), 1).otherwise(0)).alias("k"),
                (F.col("sum_rcf") + F.coalesce("b_rcf", F.lit(0.0))).alias("sum_rcf"),
                (F.col("sum_rff") + F.coalesce("b_acc", F.lit(0.0))).alias("sum_rff"),
                F.coalesce("m_new", "merit").alias("merit"),
            ),
            step,
            tables,
        )
        cand = loop_state(_update_with(bl, coded, cand.withColumn("step_no", F.lit(step)), picks.select(*SCOPE, "c")), step, tables)
    # locally predictive features: highest class correlation first, added when no chosen
    # feature correlates with it as much as the class does
    while locally_predictive:
        step += 1
        ok = cand.where(
            ~F.col("chosen")
            & (F.round("rcf", DIGITS) > 0)
            & (F.round("max_rff", DIGITS) < F.round("rcf", DIGITS))
        )
        picks = ok.groupBy(*SCOPE).agg(
            F.max_by("idx", F.struct(F.round("rcf", DIGITS), -F.col("idx"))).alias("c")
        )
        picks = materialize(picks)
        if picks.isEmpty():
            break
        cand = loop_state(_update_with(bl, coded, cand.withColumn("step_no", F.lit(step)), picks), step, tables)
    order = Window.partitionBy(*SCOPE).orderBy("order_in", "idx")  # a block holds at most m features
    chosen = cut_lineage(cand.where("chosen").select(*SCOPE, "idx", F.row_number().over(order).alias("step")))
    drop_tables(bl.train.sparkSession, tables)  # the result is its own table; the step tables can go
    return chosen
