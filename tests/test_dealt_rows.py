import random

from pyspark.sql import functions as F

from votesel.operators.attributes import typed_attributes
from votesel.operators.selectors import Blocks, class_scores
from votesel.operators.split import horizontal_assignment, horizontal_partition, horizontal_rows


def table(spark, repeated):
    rnd = random.Random(5)
    rows = [(f"r{i}", float(rnd.randrange(9)), rnd.choice(["x", "y", None]), rnd.choice("abc")) for i in range(400)]
    if repeated:
        rows += [(f"r{i}", 50.0 + i, "z", rnd.choice("abc")) for i in range(20)] + [(None, 99.0, "n", "a")]
    return spark.createDataFrame(rows, "row_id string, v double, s string, class string")


def counts(df):
    return sorted(map(str, df.select("round", "part", "v", "s", "class").groupBy("round", "part", "v", "s", "class").count().collect()))


def test_dealt_rows_are_the_partition(spark):
    for repeated in (False, True):
        df = table(spark, repeated)
        want = counts(horizontal_partition(df, 4, rounds=3, seed=7))
        for rows_per_bucket in (1, 10_000):
            dealt = horizontal_rows(df, 4, rounds=3, seed=7, rows_per_bucket=rows_per_bucket)
            assert dealt.columns == ["round", "part", "v", "s", "class"]
            assert counts(dealt) == want


def test_scores_of_dealt_rows_read_no_ids(spark):
    df = table(spark, False)
    attrs = typed_attributes(df)
    by_id, _ = class_scores(Blocks(df, attrs, assign=horizontal_assignment(df, 4, rounds=2)), ["a", "b", "c"])
    bl = Blocks(df, attrs, dealt=horizontal_rows(df, 4, rounds=2))
    dealt, _ = class_scores(bl, ["a", "b", "c"])
    key = lambda r: (r["round"], r["part"], r["idx"])
    for a, b in zip(sorted(by_id.collect(), key=key), sorted(dealt.collect(), key=key), strict=True):
        assert key(a) == key(b) and abs(a["ig"] - b["ig"]) < 1e-12
    assert bl.blocks().count() == 8
    # the values are read from the written table: nothing of them is shuffled or sorted again
    plan = bl.values()._jdf.queryExecution().executedPlan().toString()
    assert "row_id" not in plan and "SortMergeJoin" not in plan
