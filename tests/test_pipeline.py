from votesel.plans.pipeline import select_features
from votesel.sources.fixtures import doc_quality, lineitem_band
from tests.conftest import SF_SMALL


def test_planted_truth_ig(spark):
    res = select_features(lineitem_band(spark, SF_SMALL), parts=4, selectors=("IG",), measures=("F2",), k=4)
    votes = {r["feature"]: r["votes"] for r in res.votes["IG"].collect()}
    assert votes["qty"] == 0
    assert "qty" in res.selected[("IG", "F2")]
    assert all(0 <= v <= 20 for v in votes.values())


def test_cfs_keeps_planted_column(spark):
    res = select_features(lineitem_band(spark, SF_SMALL), parts=2, selectors=("CFS",), measures=("F1",), rounds=2)
    votes = {r["feature"]: r["votes"] for r in res.votes["CFS"].collect()}
    assert votes["qty"] == 0
    assert "qty" in res.selected[("CFS", "F1")]


def test_vertical_votes_identity(spark):
    from pyspark.sql import functions as F

    df = lineitem_band(spark, SF_SMALL)
    res = select_features(df, parts=2, selectors=("IG",), measures=("F1",), k=1, vertical=True, rounds=2)
    per_round = res.votes["IG"]
    assert per_round.where((F.col("votes") < 2) | (F.col("votes") > 4)).count() == 0


def test_flagship_runs(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns == ["selector", "measure", "feature"]
    assert df.count() > 0
    assert doc_quality(spark, SF_SMALL).count() > 0


def test_vertical_cfs_and_relief_run(spark):
    from pyspark.sql import functions as F

    df = lineitem_band(spark, SF_SMALL)
    res = select_features(df, parts=2, selectors=("CFS", "RF"), measures=("F2",), k=2, vertical=True, rounds=1, overlap=0.3)
    for sel in ("CFS", "RF"):
        v = res.votes[sel]
        assert v.count() == 8
        # one round of two parts: a feature collects between 0 and 2 votes
        assert v.where((F.col("votes") < 0) | (F.col("votes") > 2)).count() == 0
    assert "qty" in res.selected[("CFS", "F2")]


def test_hash_partition_mode_pipeline(spark):
    res = select_features(lineitem_band(spark, SF_SMALL), parts=3, selectors=("IG",), measures=("F1",), k=3, partition_mode="hash", rounds=2)
    votes = {r["feature"]: r["votes"] for r in res.votes["IG"].collect()}
    assert votes["qty"] == 0
