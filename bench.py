"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from votesel.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=max(8, int(cpus) * 2), app="votesel-bench")
    from votesel.plans import queries as Q
    from votesel.plans.pipeline import select_features
    from votesel.sources import fixtures as FX

    def selection(selectors, vertical=False):
        def run():
            if vertical:
                df = FX.embedding_wide(spark, sf_dir)
                res = select_features(df, parts=Q.EMB_PARTS, selectors=selectors, measures=("F1", "F2"), k=Q.EMB_K, vertical=True)
            else:
                df = FX.lineitem_band(spark, sf_dir)
                res = select_features(df, parts=Q.PARTS, selectors=selectors, measures=("F1", "F2"), k=Q.TOP_K)
            return sum(len(v) for v in res.selected.values())

        return run

    def collect(fn):
        # run the whole plan on the executors without shipping rows to Python
        return lambda: fn(spark, sf_dir).write.format("noop").mode("overwrite").save()

    plan = {
        "selection_ig_horizontal": selection(("IG",)),
        "selection_cfs_horizontal": selection(("CFS",)),
        "selection_ig_vertical": selection(("IG",), vertical=True),
        "mdl_discretize": collect(Q.q_mdl_discretize),
        "info_gain_blocks": collect(Q.q_info_gain),
        "complexity_f1_f2": lambda: (collect(Q.q_fisher_ratio)(), collect(Q.q_f2_overlap)()),
        "train_test_split": collect(Q.q_train_test_split),
        "horizontal_partition": collect(Q.q_horizontal_partition),
        "knn_1nn": collect(Q.q_knn_1nn),
        "relieff_weights": collect(Q.q_relieff_weights),
    }
    only = [a for a in sys.argv[1:]]
    times = {}
    for name, fn in plan.items():
        if only and name not in only:
            continue
        t = time.time()
        fn()
        times[name] = round(time.time() - t, 3)
    sf = sf_dir.rstrip("/").split("sf")[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
