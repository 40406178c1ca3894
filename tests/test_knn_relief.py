import random

from votesel.operators.attributes import typed_attributes
from votesel.operators.knn import knn_predict
from votesel.operators.relief import relieff_weights
from votesel.operators.selectors import Blocks
from votesel.operators.split import horizontal_assignment


def test_knn_exact_vs_bruteforce(spark):
    rnd = random.Random(5)
    train = [(i, "ab"[rnd.randrange(2)], [rnd.random(), rnd.random(), rnd.random()]) for i in range(300)]
    test = [(1000 + i, [rnd.random(), rnd.random(), rnd.random()]) for i in range(60)]
    tr = spark.createDataFrame(train, "tid long, label string, v array<double>")
    te = spark.createDataFrame(test, "qid long, v array<double>")
    got = {r["qid"]: r["prediction"] for r in knn_predict(tr, te, band_size=16).collect()}
    for qid, v in test:
        best = min(train, key=lambda t: (round(sum((a - b) ** 2 for a, b in zip(v, t[2])), 12), t[0]))
        assert got[qid] == best[1]


def brute_relief(rows, k):
    """rows: (row_id, class, [num...], [nom...]) of one block."""
    n = len(rows)
    nnum = len(rows[0][2])
    lo = [min(r[2][i] for r in rows) for i in range(nnum)]
    hi = [max(r[2][i] for r in rows) for i in range(nnum)]

    def diffs(a, b):
        d = [abs(a[2][i] - b[2][i]) / (hi[i] - lo[i]) if hi[i] > lo[i] else 0.0 for i in range(nnum)]
        return d + [0.0 if x == y else 1.0 for x, y in zip(a[3], b[3])]

    classes = sorted({r[1] for r in rows})
    prior = {c: sum(1 for r in rows if r[1] == c) / n for c in classes}
    w = [0.0] * (nnum + len(rows[0][3]))
    for q in rows:
        for c in classes:
            cand = [t for t in rows if t[1] == c and t[0] != q[0]]
            cand.sort(key=lambda t: (round(sum(diffs(q, t)), 12), t[0]))
            nb = cand[:k]
            if not nb:
                continue
            f = -1.0 if c == q[1] else prior[c] / (1 - prior[q[1]])
            for t in nb:
                for i, d in enumerate(diffs(q, t)):
                    w[i] += f * d / len(nb)
    return [x / n for x in w]


def test_knn_ties_short_bands_and_split_orders(spark):
    rng = random.Random(5)
    pts = [(i, f"c{rng.randrange(3)}", [float(rng.randrange(4)) for _ in range(3)]) for i in range(151)]
    df = spark.createDataFrame(pts, "tid long, label string, v array<double>")
    qs = df.selectExpr("tid as qid", "v")
    for size, rows_per_task in ((16, 40), (150, 2_000_000)):
        for own in (False, True):
            found = knn_predict(df, qs, band_size=size, exclude_self=own, rows_per_task=rows_per_task).collect()
            want = {
                i: min((sum((x - y) ** 2 for x, y in zip(v, w)), j, label) for j, label, w in pts if not (own and i == j))[2]
                for i, _, v in pts
            }
            assert {r["qid"]: r["prediction"] for r in found} == want


def test_relieff_vs_bruteforce(spark):
    rnd = random.Random(9)
    data = []
    for i in range(120):
        c = rnd.randrange(3)
        data.append((i, float(c * 2 + rnd.random() * 3), rnd.random(), "xyz"[rnd.randrange(3)], str(c)))
    df = spark.createDataFrame(data, "row_id long, a double, b double, n string, class string")
    attrs = typed_attributes(df)
    assign = horizontal_assignment(df, 2, rounds=1, seed=1)
    bl = Blocks(df, attrs, assign=assign)
    got = {(r["part"], r["idx"]): r["weight"] for r in relieff_weights(bl, None, k=5, band_size=8).collect()}
    parts = {r["row_id"]: r["part"] for r in assign.collect()}
    for p in (0, 1):
        rows = [(d[0], d[4], [d[1], d[2]], [d[3]]) for d in data if parts[d[0]] == p]
        exp = brute_relief(rows, 5)
        for i, e in enumerate(exp):
            assert abs(got[(p, i)] - e) < 1e-9, (p, i, got[(p, i)], e)


def test_relieff_sample_size(spark):
    rnd = random.Random(4)
    data = [(i, float(c + rnd.random()), "uv"[rnd.randrange(2)], str(c)) for i in range(80) for c in [rnd.randrange(2)]]
    df = spark.createDataFrame(data, "row_id long, a double, n string, class string")
    assign = horizontal_assignment(df, 1, rounds=1, seed=1)
    bl = Blocks(df, typed_attributes(df), assign=assign)
    full = {r["idx"]: r["weight"] for r in relieff_weights(bl, None, k=3).collect()}
    every = {r["idx"]: r["weight"] for r in relieff_weights(bl, None, k=3, sample_size=80).collect()}
    assert all(abs(full[i] - every[i]) < 1e-12 for i in full)  # drawing everyone changes nothing
    part = {r["idx"]: r["weight"] for r in relieff_weights(bl, None, k=3, sample_size=20).collect()}
    assert set(part) == {0, 1} and part[0] > part[1]  # the class-driven column outranks the noise
