import hashlib
import random

from pyspark.sql import functions as F

from votesel.operators.discretize import (
    candidates_from,
    interval_counts,
    mdl_best,
    mdl_cuts,
    mdl_levels,
    near_lowest,
    prepare_histogram,
    running_counts,
    value_histogram,
)
from votesel.operators.ranking import join_few, sort_tasks
from votesel.operators.split import assign_folds, horizontal_partition, horizontal_rows

KEYS = ["round", "part", "idx"]
CLASSES = ["a", "b", "c"]


def cells(spark, n=9000):
    rnd = random.Random(11)
    rows = []
    for i in range(n):
        v = rnd.random() * 30
        rows.append((1 + i % 2, i % 3, 4, round(v, 3), rnd.choice("abc") if rnd.random() < 0.1 else "abc"[int(v) // 10]))
    return spark.createDataFrame(rows, "round int, part int, idx int, num double, class string")


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_packed_keys_give_the_same_running_counts(spark):
    df = cells(spark, 900)
    cls = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class")).cast("int") - 1
    ranged = df.select(*KEYS, F.when(F.col("num") <= 9.0, 0).otherwise(1).alias("_bkt"), F.col("num").alias("value"), cls.alias("cls"))
    want, want_roots = prepare_histogram(value_histogram(df, KEYS, CLASSES), KEYS, 3)
    for spans in (None, {"round": (1, 2), "part": (0, 3), "idx": (4, 1)}):
        got, roots = running_counts(ranged, KEYS, CLASSES, 900, 2, spans)
        assert rows_of(got.select(*want.columns)) == rows_of(want)
        assert rows_of(roots.select(*want_roots.columns)) == rows_of(want_roots)
        assert dict(got.dtypes)["round"] == dict(want.dtypes)["round"]


def test_best_boundaries_lie_in_the_runs_kept(spark):
    df = cells(spark, 60_000)
    cum, roots = prepare_histogram(value_histogram(df.withColumn("part", F.lit(0)), KEYS, CLASSES), KEYS, 3)
    active = cum.join(roots, [*KEYS, "node"])
    near = near_lowest(active, KEYS, 3)
    assert near.count() < active.count()
    want = mdl_best(candidates_from(active, KEYS, 3), KEYS, 3)
    assert rows_of(mdl_best(candidates_from(near, KEYS, 3), KEYS, 3)) == rows_of(want)
    cuts = mdl_cuts(cum, roots, KEYS, 3)
    assert cuts.count() >= 4
    assert rows_of(cuts) == rows_of(mdl_cuts(cum, roots, KEYS, 3, rows_per_level=0))


def test_interval_counts_are_those_of_the_coded_values(spark):
    cum, roots = prepare_histogram(value_histogram(cells(spark), KEYS, CLASSES), KEYS, 3)
    coded, _ = mdl_levels(cum, roots, KEYS, 3)
    want = coded.groupBy(*KEYS, "code").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(3)])
    cuts = mdl_cuts(cum, roots, KEYS, 3)
    assert want.count() > 12
    assert rows_of(interval_counts(cuts, roots, KEYS, 3)) == rows_of(want)


def test_few_rows_are_looked_up_by_one_number(spark):
    rows = spark.createDataFrame([(1, "x", 5), (1, None, 6), (2, "x", 7), (1, "y", 8)], "a int, b string, v int")
    few = spark.createDataFrame([(1, "x", 50), (1, "x", 51), (1, None, 60), (2, "z", 70)], "a int, b string, w int")
    got = join_few(rows, few, ["a", "b"])
    assert rows_of(got.select("a", "b", "v", "w")) == rows_of(rows.join(few, ["a", "b"]))
    assert sort_tasks(rows, 10) == [] and sort_tasks(rows, 10**9) == [1000]


def test_folds_of_md5_ids_and_others(spark):
    def folds(ids, rows_per_task):
        df = spark.createDataFrame([(x, "ab"[i % 2]) for i, x in enumerate(ids)], "row_id string, class string")
        got = {r["row_id"]: r["fold"] for r in assign_folds(df, rows_per_task=rows_per_task).collect()}
        for c in "ab":
            own = sorted(x for i, x in enumerate(ids) if "ab"[i % 2] == c)
            assert [got[x] for x in own] == [i % 3 for i in range(len(own))]

    md5 = [hashlib.md5(str(i).encode()).hexdigest() for i in range(400)]
    for ids in (md5, [*md5, "not hex"], [f"r{i}" for i in range(60)]):
        folds(ids, 2_000_000)
    folds(md5, 50)
    folds(md5, 1)  # more digits than the classes are counted by


def test_dealt_classes_without_a_code(spark):
    rnd = random.Random(2)
    rows = [(f"r{i}", float(i % 5), rnd.choice([1, 2, 3, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id string, v double, class int")
    want = rows_of(horizontal_partition(df, 4, rounds=2).groupBy("round", "part", "v", "class").count())
    for one in (1, 10_000):
        dealt = horizontal_rows(df, 4, rounds=2, rows_per_bucket=one)
        assert rows_of(dealt.groupBy("round", "part", "v", "class").count()) == want
        text = horizontal_rows(df.withColumn("class", F.col("class").cast("string")), 4, rounds=2, rows_per_bucket=one)
        text = text.withColumn("class", F.col("class").cast("int"))
        assert rows_of(text.groupBy("round", "part", "v", "class").count()) == want
