import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from votesel.operators import split
from votesel.operators.split import horizontal_assignment


def table(spark, short):
    ids = F.md5(F.col("id").cast("string"))
    df = spark.range(600).select((F.substring(ids, 1, 9) if short else ids).alias("row_id"), F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("class"))
    return df.unionByName(spark.createDataFrame([(None, "1")], "row_id string, class string"))


def brute(rows, parts, rounds, seed):
    out, classes = [], defaultdict(list)
    for r in rows:
        classes[r["class"]].append(r["row_id"])
    for c, ids in classes.items():
        for rnd in range(1, rounds + 1):
            order = sorted(ids, key=lambda i: hashlib.md5("|".join([str(seed), str(rnd)] + ([i] if i is not None else [])).encode()).hexdigest())
            out += [(rnd, k % parts, i) for k, i in enumerate(order)]
    return sorted(map(str, out))


@pytest.mark.parametrize("short", [False, True])
def test_assignment_matches_brute_force(spark, short):
    df = table(spark, short)
    want = brute(df.collect(), 4, 3, 42)
    for rows_per_task in (2_000_000, 20):
        got = split._ranked_assignment(df, 4, 3, 42, rows_per_task)
        assert sorted(map(str, map(tuple, got.collect()))) == want


def test_only_ids_are_shuffled(spark):
    df = spark.range(600).select(F.md5(F.col("id").cast("string")).alias("row_id"), F.lit("a").alias("class"))
    plan = horizontal_assignment(df, 4)._jdf.queryExecution().executedPlan().toString().split("\n")
    at = [i for i, line in enumerate(plan) if " Exchange " in line]
    assert len(at) == 1  # and what it sends holds no order key
    assert "unhex(" in plan[at[0] + 1] and not any(f" AS {c}" in line for line in plan[at[0] :] for c in ("_h", "_w0"))
