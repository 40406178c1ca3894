import random

from votesel.plans.queries import q_run_report

TYPES = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"


def test_report_holds_every_selector_and_classifier(spark, tmp_path):
    rnd = random.Random(3)
    rows = [
        (i, 1 + i % 7, i % 20, float(rnd.randint(1, 50)), rnd.randint(100, 900) / 4, rnd.randint(0, 10) / 100, rnd.randint(0, 8) / 100, rnd.choice("ANR"), rnd.choice("OF"))
        for i in range(240)
    ]
    rows += [(500 + i, 1, 1, None, None, 0.05, 0.02, "A", None) for i in range(6)]  # class 'high' of unknown quantity
    spark.createDataFrame(rows, TYPES).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.selector, r.measure, r.metric): r.value for r in q_run_report(spark, str(tmp_path)).collect()}
    assert got[("", "", "features")] == 8
    assert got[("", "", "train_rows")] + got[("", "", "test_rows")] == 246
    for sel in ("CFS", "IG", "RF"):
        assert got[(sel, "", "blocks")] == 20
        for meas in ("F1", "F2"):
            for name in ("SVM", "DT", "NB", "KNN"):
                assert 0 < got[(sel, meas, f"accuracy_{name}")] <= 1
    assert got[("CFS", "F2", "accuracy_DT")] > 0.9  # the quantity is among the features kept
