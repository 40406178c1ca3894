"""The flagship run: CFS and IG selection on document-quality features (FIXTURES F4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from votesel.plans.pipeline import select_features
from votesel.sources.fixtures import doc_quality


def flagship(spark: SparkSession, sf_dir: str, parts: int = 2) -> DataFrame:
    res = select_features(doc_quality(spark, sf_dir), parts=parts, selectors=("CFS", "IG"), measures=("F1", "F2"))
    rows = [(s, m, f) for (s, m), feats in res.selected.items() for f in feats]
    return spark.createDataFrame(rows, "selector string, measure string, feature string")
