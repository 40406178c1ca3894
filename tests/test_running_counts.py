import math
import random

from pyspark.sql import functions as F

from votesel.operators.attributes import typed_attributes
from votesel.operators.discretize import mdl_best, mdl_candidates, prepare_histogram, running_counts, value_histogram
from votesel.operators.selectors import Blocks, class_scores, coded_rows
from votesel.operators.split import deal_rows, horizontal_rows


def table(spark, n=600):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        v = float(rnd.randrange(12))
        many = rnd.choice([rnd.random(), 0.5, None, math.nan, -rnd.random()])
        rows.append((f"r{i}", v, many, rnd.choice(["x", "y", None]), "abc"[int(v) // 4]))
    return spark.createDataFrame(rows, "row_id string, few double, many double, s string, class string")


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_running_counts_are_those_of_the_histogram(spark):
    df = table(spark).withColumn("idx", F.lit(1))
    classes = ["a", "b", "c"]
    cells = df.where("many IS NOT NULL").withColumn("num", F.col("many"))
    want, want_roots = prepare_histogram(value_histogram(cells, ["idx"], classes), ["idx"], 3)
    bkt = F.when(F.col("many") <= 0.0, 0).when(F.col("many") <= 0.5, 1).otherwise(2)
    cls = F.array_position(F.array(*map(F.lit, classes)), F.col("class")).cast("int") - 1
    ranged = cells.select("idx", bkt.alias("_bkt"), F.col("many").alias("value"), cls.alias("cls"))
    got, roots = running_counts(ranged, ["idx"], classes, 600, 3)
    assert rows_of(got.select(*want.columns)) == rows_of(want)
    assert rows_of(roots.select(*want_roots.columns)) == rows_of(want_roots)


def test_scores_do_not_depend_on_how_values_are_counted(spark):
    df = table(spark).where("NOT isnan(many) OR many IS NULL")
    rows, places = deal_rows(df, 4, rounds=2)
    assert rows_of(places) == rows_of(rows.select("round", "part").distinct())
    bl = Blocks(df, typed_attributes(df), dealt=rows, places=places)
    found = []
    for many_rows in (0, 10**9):
        scores, cuts = class_scores(bl, ["a", "b", "c"], many_rows=many_rows)
        found.append((rows_of(scores.select("round", "part", "idx", F.round("su", 9))), rows_of(cuts)))
    assert bl.value_ranges(0)[0].keys() == {1}
    assert found[0] == found[1]
    coded = coded_rows(bl, cuts)
    assert coded.count() < df.count()  # equal rows are counted, not kept one by one
    assert coded.agg(F.sum("n")).first()[0] == 2 * df.count()


def test_best_boundary_sorts_only_what_ties(spark):
    df = table(spark).where("many IS NOT NULL").selectExpr("1 AS idx", "few AS num", "class")
    cum, roots = prepare_histogram(value_histogram(df, ["idx"], ["a", "b", "c"]), ["idx"], 3)
    best = mdl_best(mdl_candidates(cum, roots, ["idx"], 3), ["idx"], 3, intervals=1)
    assert "_low" in best._jdf.queryExecution().executedPlan().toString()
    assert best.first()["cut"] in (3.0, 7.0)


def test_dealt_rows_carry_codes(spark):
    df = table(spark, 50).drop("many")
    plan = horizontal_rows(df, 4, rounds=2)
    assert plan.columns == ["round", "part", "few", "s", "class"]
    files = {c for f in plan.inputFiles()[:1] for c in spark.read.parquet(f).columns}
    assert {"_c0", "_c1"} <= files and "few" not in files
