import math

from pyspark.sql import functions as F

from votesel.operators.info import class_entropy, pair_measures


def H(counts):
    n = sum(counts)
    return -sum(c / n * math.log2(c / n) for c in counts if c)


def test_pair_measures_hand_computed(spark):
    # a x b contingency: a in {x, y}, b in {p, q}
    rows = [("g", "x", "p", 3), ("g", "x", "q", 1), ("g", "y", "p", 1), ("g", "y", "q", 3)]
    ct = spark.createDataFrame(rows, "g string, a string, b string, n long")
    r = pair_measures(ct, ["g"], "a", "b").first()
    ha, hb, hab = H([4, 4]), H([4, 4]), H([3, 1, 1, 3])
    assert abs(r["h_a"] - ha) < 1e-12 and abs(r["h_b"] - hb) < 1e-12 and abs(r["h_ab"] - hab) < 1e-12
    ig = ha + hb - hab
    assert abs(r["ig"] - ig) < 1e-12
    assert abs(r["su"] - 2 * ig / (ha + hb)) < 1e-12


def test_su_bounds_and_zero(spark):
    rows = [("g", "x", "p", 5), ("h", "x", "p", 2), ("h", "y", "q", 2)]
    ct = spark.createDataFrame(rows, "g string, a string, b string, n long")
    got = {r["g"]: r["su"] for r in pair_measures(ct, ["g"], "a", "b").collect()}
    assert got["g"] == 0.0  # both entropies 0
    assert abs(got["h"] - 1.0) < 1e-12  # perfectly dependent


def test_class_entropy(spark):
    df = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(8)], "row_id int, class string")
    r = class_entropy(df).first()
    assert r["n"] == 8 and abs(r["h_class"] - H([3, 5])) < 1e-12
    per = class_entropy(df.withColumn("k", F.lit(1)), keys=["k"]).first()
    assert abs(per["h_class"] - H([3, 5])) < 1e-12
