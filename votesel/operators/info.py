"""Contingency tables and the information measures built on them.

Every measure is computed from counts with ``H = log2(N) - sum(n*log2(n))/N``
(bits), the same expression the oracle SQL uses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votesel.operators.discretize import interval_counts, mdl_cuts, prepare_histogram, value_histogram
from votesel.session import materialize


def _nlogn(c):
    return F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))


def _h(s, n):
    return F.when(n > 0, F.log2(n) - s / n).otherwise(F.lit(0.0))


def pair_measures(ct: DataFrame, keys: Sequence[str], a: str, b: str, n: str = "n") -> DataFrame:
    """``keys, n_total, h_a, h_b, h_ab, ig, su`` from a contingency ``keys, a, b, n``.

    ``ig`` = H(a) + H(b) - H(a,b) (information gain when b is the class) and
    ``su`` = 2 ig / (H(a) + H(b)), 0 when both entropies are 0.
    """
    keys = list(keys)
    ha = ct.groupBy(*keys, a).agg(F.sum(n).alias("_m")).groupBy(*keys).agg(F.sum(_nlogn(F.col("_m"))).alias("_sa"))
    hb = ct.groupBy(*keys, b).agg(F.sum(n).alias("_m")).groupBy(*keys).agg(F.sum(_nlogn(F.col("_m"))).alias("_sb"))
    hab = ct.groupBy(*keys).agg(F.sum(_nlogn(F.col(n))).alias("_sab"), F.sum(n).alias("n_total"))
    j = hab.join(ha, keys).join(hb, keys)
    h_a = _h(F.col("_sa"), F.col("n_total"))
    h_b = _h(F.col("_sb"), F.col("n_total"))
    h_ab = _h(F.col("_sab"), F.col("n_total"))
    out = j.select(*keys, F.col("n_total").cast("bigint").alias("n_total"), h_a.alias("h_a"), h_b.alias("h_b"), h_ab.alias("h_ab"))
    ig = F.col("h_a") + F.col("h_b") - F.col("h_ab")
    su = F.when(F.col("h_a") + F.col("h_b") > 0, 2 * ig / (F.col("h_a") + F.col("h_b"))).otherwise(F.lit(0.0))
    return out.select("*", ig.alias("ig"), su.alias("su"))


def class_entropy(df: DataFrame, label: str = "class", keys: Sequence[str] = ()) -> DataFrame:
    """``keys, n, h_class``: entropy of the class distribution (per group of ``keys``)."""
    keys = list(keys)
    c = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_m"))
    g = c.groupBy(*keys).agg(F.sum(_nlogn(F.col("_m"))).alias("_s"), F.sum("_m").alias("n"))
    return g.select(*keys, F.col("n").cast("bigint").alias("n"), _h(F.col("_s"), F.col("n")).alias("h_class"))


def nominal_contingency(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, idx, code, class, n`` for nominal cells (code = the string value)."""
    return cells.groupBy(*keys, "idx", F.col("cat").alias("code"), "class").agg(F.count(F.lit(1)).alias("n"))


def histogram_contingency(coded: DataFrame, keys: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """Contingency ``keys, idx, code, class, n`` of discretized numeric features, from the counts of coded values or intervals."""
    k = len(classes)
    per = coded.groupBy(*keys, "idx", F.col("code").cast("string").alias("code")).agg(
        *[F.sum(f"n{i}").alias(f"n{i}") for i in range(k)]
    )
    stack = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"n{i}").alias("n")) for i, c in enumerate(classes)])
    return per.select(*keys, "idx", "code", F.inline(stack)).where(F.col("n") > 0)


def feature_class_contingency(
    cells: DataFrame,
    keys: Sequence[str],
    classes: Sequence[str],
    better_encoding: bool = True,
    nominal: DataFrame | None = None,
    running: tuple[DataFrame, DataFrame] | None = None,
):
    """Contingency of every feature (MDL-coded numeric, raw nominal) with the class, per scope.

    ``cells``: ``keys, idx, num, cat, class``; ``nominal``: the nominal cells, if they come apart from the
    numeric ones; ``running``: running counts and roots of further numeric features, if those are not among the
    cells. Returns ``(ct, cuts)``.
    """
    keys = list(keys)
    gkeys = [*keys, "idx"]
    num = cells.where(F.col("num").isNotNull())
    nom = (cells if nominal is None else nominal).where(F.col("cat").isNotNull())
    hist = value_histogram(num, gkeys, classes)
    cum, roots = prepare_histogram(hist, gkeys, len(classes))
    if running is not None:
        cum, roots = cum.unionByName(running[0]), roots.unionByName(running[1])
    cuts = mdl_cuts(cum, roots, gkeys, len(classes), better_encoding)
    ct_num = histogram_contingency(interval_counts(cuts, roots, gkeys, len(classes)), keys, classes)
    ct = ct_num.unionByName(nominal_contingency(nom, keys))
    return materialize(ct), cuts.select(*gkeys, "cut", "depth")


def info_gain(ct: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, idx, ig, su, h_feature, h_class`` per feature from its class contingency."""
    m = pair_measures(ct, [*keys, "idx"], "code", "class")
    return m.select(*keys, "idx", "ig", "su", F.col("h_a").alias("h_feature"), F.col("h_b").alias("h_class"))


def rank_top_k(scores: DataFrame, keys: Sequence[str], k: int, score: str = "score") -> DataFrame:
    """Top ``k`` features per group by score (ties: lowest idx), after rounding to 9 digits.

    Groups are (round, part) blocks, so a group holds at most the feature count.
    """
    w = Window.partitionBy(*keys).orderBy(F.round(F.col(score), 9).desc(), F.col("idx"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
