"""The full run: split, partition, select per block, vote, sweep the threshold, evaluate.

Everything up to the chosen threshold is DataFrame plans. Driver round trips:
the attribute list (m entries), the class labels, one "anything changed" check
per MDL level and per CFS step, the chosen threshold, and the final feature list.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votesel.operators.attributes import Attr, drop_rare_classes, typed_attributes
from votesel.operators.complexity import class_feature_stats, feature_measures
from votesel.operators.discretize import class_list
from votesel.operators.selectors import Blocks, cfs_select, class_scores, ig_select
from votesel.operators.split import attrs_frame, deal_rows, horizontal_assignment, train_test_split, vertical_partition
from votesel.operators.threshold import (
    candidate_subsets,
    choose,
    score_candidates,
    selected_features,
    thresholds,
    vote_range,
)
from votesel.operators.votes import block_sizes, cfs_mean_size, part_stats, partition_votes, vote_stats, vote_totals
from votesel.session import materialize

SELECTORS = ("CFS", "IG", "RF")
MEASURES = ("F1", "F2", "none", "SVM", "KNN", "DT", "NB")


@dataclass
class SelectionResult:
    train: DataFrame
    test: DataFrame
    attrs: list[Attr]
    votes: dict[str, DataFrame] = field(default_factory=dict)  # selector -> idx, feature, votes
    block_selected: dict[str, DataFrame] = field(default_factory=dict)  # selector -> round, part, idx
    sweeps: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    chosen: dict[tuple[str, str], tuple[int | None, bool]] = field(default_factory=dict)
    selected: dict[tuple[str, str], list[str]] = field(default_factory=dict)
    metrics: list[tuple] = field(default_factory=list)  # (selector, measure, metric, value)
    timings: dict[str, float] = field(default_factory=dict)

    def metrics_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.metrics, "selector string, measure string, metric string, value double")


def prepare(
    df: DataFrame,
    attrs: Sequence[Attr] | None = None,
    min_count: int = 2,
    test_df: DataFrame | None = None,
    label: str = "class",
):
    """Rare-class filter, attributes, split. Train is persisted (reused by every stage; its
    lineage is a scan plus the split); test stays lazy until evaluation."""
    df = drop_rare_classes(df, min_count, label)
    attrs = list(attrs) if attrs is not None else typed_attributes(df, label)
    train, test = train_test_split(df, label, test_df=test_df)
    return materialize(train), test, attrs


def make_blocks(
    train: DataFrame,
    attrs: Sequence[Attr],
    parts: int,
    rounds: int = 5,
    seed: int = 42,
    vertical: bool = False,
    overlap: float = 0.0,
    partition_mode: str = "rank",
    with_ids: bool = True,
) -> Blocks:
    """Blocks of one run; without ``with_ids`` (no selector needs row ids) horizontal rows carry none."""
    if vertical:
        vpart = materialize(vertical_partition(attrs_frame(train.sparkSession, attrs), parts, rounds, seed, overlap))
        return Blocks(train, attrs, vpart=vpart)
    if partition_mode == "rank" and not with_ids:
        rows, places = deal_rows(train, parts, rounds, seed)
        return Blocks(train, attrs, dealt=rows, places=places)
    return Blocks(train, attrs, assign=materialize(horizontal_assignment(train, parts, rounds, seed, partition_mode)))


def select_features(
    df: DataFrame,
    parts: int,
    selectors: Sequence[str] = ("CFS", "IG", "RF"),
    measures: Sequence[str] = ("F1", "F2"),
    rounds: int = 5,
    alpha: float = 0.75,
    vertical: bool = False,
    overlap: float = 0.0,
    seed: int = 42,
    k: int | None = None,
    attrs: Sequence[Attr] | None = None,
    test_df: DataFrame | None = None,
    partition_mode: str = "rank",
    min_count: int = 2,
    evaluate: bool = False,
    models: Sequence[str] = ("SVM", "DT", "NB", "KNN"),
    relief_neighbours: int = 10,
    relief_sample_size: int | None = None,
) -> SelectionResult:
    """Partition-and-vote feature selection (see README for the semantics)."""
    if parts < 1:
        raise ValueError("parts must be positive")
    if not 0.0 <= alpha <= 1.0:
        raise ValueError("alpha must be in [0, 1]")
    for s in selectors:
        if s not in SELECTORS:
            raise ValueError(f"unknown selector {s!r}")
    for m_ in measures:
        if m_ not in MEASURES:
            raise ValueError(f"unknown complexity measure {m_!r}")
    t0 = time.time()
    spark = df.sparkSession
    train, test, attrs = prepare(df, attrs, min_count, test_df)
    if evaluate:
        test = materialize(test)  # read by every fit of the evaluation
    res = SelectionResult(train, test, list(attrs))
    m = len(attrs)
    if evaluate:
        res.metrics += [("", "", name, float(n)) for name, n in (("features", m), ("train_rows", train.count()), ("test_rows", test.count()))]
    attrs_df = attrs_frame(spark, attrs)
    classes = class_list(train)
    bl = make_blocks(train, attrs, parts, rounds, seed, vertical, overlap, partition_mode, with_ids="RF" in selectors)
    scores, cuts = class_scores(bl, classes)
    blocks = materialize(bl.blocks())
    fm = materialize(feature_measures(class_feature_stats(train, attrs)))
    res.timings["prepare"] = time.time() - t0
    cfs_k = None
    evaluated: dict[tuple[str, ...], list[tuple[str, float]]] = {}  # selectors and measures often agree on the features
    for sel in selectors:
        t1 = time.time()
        if sel == "CFS":
            picked = cfs_select(bl, classes, scores, cuts)
        elif sel == "IG":
            picked = ig_select(bl, classes, k or cfs_k or max(1, m // 2), scores)
        else:
            from votesel.operators.relief import relieff_select

            picked = relieff_select(bl, classes, k or cfs_k or max(1, m // 2), relief_neighbours, relief_sample_size, seed)
        picked = materialize(picked.select("round", "part", "idx"))
        res.block_selected[sel] = picked
        votes = materialize(vote_totals(partition_votes(picked, blocks, attrs_df, rounds)))
        res.votes[sel] = votes
        ps = part_stats(block_sizes(picked, blocks)).first()
        res.metrics += [
            (sel, "", "blocks", float(ps["n_blocks"])),
            (sel, "", "mean_selected", float(ps["mean_selected"] or 0.0)),
        ]
        if sel == "CFS":
            mean_size = cfs_mean_size(picked, blocks, m).first()["cfs_mean_size"]
            res.metrics.append((sel, "", "cfs_mean_size", float(mean_size or 0)))
        vs = vote_stats(votes)
        ths = thresholds(vote_range(vs, vertical, parts, rounds))
        cands = materialize(candidate_subsets(votes, ths, fm))
        for meas in measures:
            comp = None
            if meas in ("SVM", "KNN", "DT", "NB"):
                from votesel.operators.models import classifier_complexity

                comp = classifier_complexity(train, attrs, votes, cands, meas)
            sweep = score_candidates(cands, meas, m, alpha, comp)
            a, fb = choose(sweep)
            feats = [r["feature"] for r in selected_features(votes, a, fb).collect()]
            res.sweeps[(sel, meas)] = sweep
            res.chosen[(sel, meas)] = (a, fb)
            res.selected[(sel, meas)] = feats
            res.metrics += [
                (sel, meas, "threshold", float(a) if a is not None else float("nan")),
                (sel, meas, "n_features", float(len(feats))),
            ]
            if sel == "CFS":
                cfs_k = len(feats)
            if evaluate:
                from votesel.operators.models import evaluate_models

                subset = tuple(sorted(feats))
                if subset not in evaluated:
                    evaluated[subset] = evaluate_models(train, test, attrs, feats, models)
                for name, acc in evaluated[subset]:
                    res.metrics.append((sel, meas, f"accuracy_{name}", float(acc)))
        res.timings[sel] = time.time() - t1
    res.timings["total"] = time.time() - t0
    return res


def report(res: SelectionResult) -> list[tuple]:
    """Metric rows plus timings, as the reference prints them."""
    rows = list(res.metrics)
    rows += [("", "", f"time_{k}_sec", float(v)) for k, v in res.timings.items()]
    return rows


def run_report_frame(spark, res: SelectionResult) -> DataFrame:
    """The report without its wall times, which no two runs share."""
    return spark.createDataFrame(report(res), "selector string, measure string, metric string, value double").where(
        ~F.col("metric").startswith("time_")
    )
