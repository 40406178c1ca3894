"""Inputs that users bring: odd labels and column names, all-nominal tables, deep trees, several text files."""

import random

from pyspark.sql import functions as F

from tests.test_knn_relief import brute_relief
from votesel.operators.attributes import cast_numeric, infer_attributes, typed_attributes
from votesel.operators.discretize import mdl_discretize, value_histogram
from votesel.operators.relief import relieff_weights
from votesel.operators.selectors import Blocks
from votesel.operators.split import horizontal_assignment
from votesel.plans.pipeline import select_features
from votesel.sources.text import read_lines, read_text_table


def nominal_table(spark, names=("a", "b", "c"), n=90):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        c = rnd.randrange(3)
        rows.append((i, "uvw"[c], "xy"[rnd.randrange(2)], "pqr"[c if rnd.random() < 0.7 else rnd.randrange(3)], ["k\\l", "it's", 'say "x"'][c]))
    return rows, spark.createDataFrame(rows, ["row_id", *names, "class"])


def test_labels_with_backslash_and_quotes_are_counted(spark):
    rows = [(1.0, "a\\b"), (2.0, "it's"), (2.0, "a\\b")]
    hist = value_histogram(spark.createDataFrame(rows, "num double, class string"), [], ["a\\b", "it's"])
    assert sorted(map(tuple, hist.collect())) == [(1.0, 1, 0), (2.0, 1, 1)]


def test_relieff_of_nominal_features_only(spark):
    rows, df = nominal_table(spark)
    bl = Blocks(df, typed_attributes(df), assign=horizontal_assignment(df, 1, rounds=1))
    got = {r["idx"]: r["weight"] for r in relieff_weights(bl, None, k=4, band_size=8).collect()}
    exp = brute_relief([(r[0], r[4], [], list(r[1:4])) for r in rows], 4)
    assert all(abs(got[i] - e) < 1e-9 for i, e in enumerate(exp))


def test_nominal_table_with_dotted_names_through_all_selectors(spark):
    _, df = nominal_table(spark, ("n.chars", "b", "c`d"))
    res = select_features(df, parts=2, rounds=1, k=1, relief_neighbours=3)
    assert {s for s, _ in res.selected} == {"CFS", "IG", "RF"}
    assert all("n.chars" in feats for feats in res.selected.values())


def test_striped_feature_is_cut_at_every_stripe(spark):
    # pure stripes of one class each: the cuts peel off at one end, level by level
    stripes = [(0, float(i), 10_000 * (i % 2 == 0), 10_000 * (i % 2)) for i in range(12)]
    hist = spark.createDataFrame(stripes, "idx int, value double, n0 long, n1 long")
    _, cuts = mdl_discretize(hist, ["idx"], 2)
    found = [(r["cut"], r["depth"]) for r in cuts.collect()]
    assert sorted(c for c, _ in found) == [float(i) for i in range(11)]


def test_lines_are_numbered_by_file_then_position(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1,x,k\n2,y,k\n")
    (tmp_path / "b.txt").write_text("".join(f"v{i},x,m\n" for i in range(500)) + "short,m\n")
    got = [r["value"] for r in read_lines(spark, str(tmp_path)).orderBy("row_id").collect()]
    assert got[:3] == ["1,x,k", "2,y,k", "v0,x,m"] and len(got) == 503 and got[-1] == "short,m"
    assert [r[0] for r in read_lines(spark, str(tmp_path)).select("row_id").orderBy("row_id").collect()] == list(range(503))
    rows, bad = read_text_table(spark, str(tmp_path))
    assert rows.count() == 502 and [tuple(r) for r in bad.collect()] == [(502, "short,m", 2)]
    assert [a.kind for a in infer_attributes(rows)] == ["numeric", "nominal"]
    assert cast_numeric(rows.where("class = 'k'"), infer_attributes(rows)).agg(F.sum("att_0")).first()[0] == 3.0


def test_empty_text_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("")
    rows, bad = read_text_table(spark, str(tmp_path))
    assert rows.count() == 0 and bad.count() == 0 and rows.columns == ["row_id", "class"]


def test_long_arrays_count_in_broadcast_size(spark):
    from votesel.operators.ranking import checked_broadcast

    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    wide = spark.range(1).selectExpr("id", "transform(sequence(1, 100000), i -> sha2(string(i), 256)) AS a")
    assert not hinted(checked_broadcast(wide, max_bytes=1_000_000))
    assert hinted(checked_broadcast(spark.range(10), max_bytes=1_000_000))
