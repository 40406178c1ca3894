import math
import random
import signal

import pytest

from votesel.operators.discretize import mdl_discretize, value_histogram


def _ent(c):
    n = sum(c)
    return -sum(x / n * math.log2(x / n) for x in c if x) if n else 0.0


def brute_mdl(points, k):
    """Plain recursive Fayyad-Irani MDL with the 'better encoding' (distinct values - 1)."""
    cuts = []

    def rec(pts):
        vals = sorted({v for v, _ in pts})
        if len(vals) < 2:
            return
        n = len(pts)
        tot = [0] * k
        for _, c in pts:
            tot[c] += 1
        hp = _ent(tot)
        best = None
        for v in vals[:-1]:
            left = [0] * k
            for x, c in pts:
                if x <= v:
                    left[c] += 1
            right = [t - lft for t, lft in zip(tot, left)]
            nl, nr = sum(left), sum(right)
            e = (nl * _ent(left) + nr * _ent(right)) / n
            if best is None or round(e, 12) < round(best[0], 12):
                best = (e, v, left, right)
        e, v, left, right = best
        if not round(e, 12) < round(hp, 12):
            return
        ka = sum(1 for t in tot if t)
        kl = sum(1 for t in left if t)
        kr = sum(1 for t in right if t)
        delta = math.log2(3**ka - 2) - (ka * hp - kl * _ent(left) - kr * _ent(right))
        if hp - e > (math.log2(len(vals) - 1) + delta) / n:
            cuts.append(v)
            rec([p for p in pts if p[0] <= v])
            rec([p for p in pts if p[0] > v])

    rec(points)
    return sorted(cuts)


def _run(spark, points, k, rows_per_task=2_000_000):
    df = spark.createDataFrame([(0, float(v), str(c)) for v, c in points], "g int, num double, class string")
    hist = value_histogram(df, ["g"], [str(i) for i in range(k)])
    _, cuts = mdl_discretize(hist, ["g"], k, rows_per_task=rows_per_task)
    return sorted(r["cut"] for r in cuts.collect())


def test_single_clean_split(spark):
    pts = [(v, 0 if v <= 5 else 1) for v in range(1, 11) for _ in range(3)]
    assert _run(spark, pts, 2) == [5.0]


def test_matches_bruteforce_random(spark):
    rnd = random.Random(7)
    for trial in range(3):
        pts = []
        for _ in range(300):
            c = rnd.randrange(3)
            v = rnd.randint(0, 40) + 15 * c
            pts.append((v, c))
        assert _run(spark, pts, 3) == [float(x) for x in brute_mdl(pts, 3)], trial


def test_bucketed_running_sums_same_result(spark):
    rnd = random.Random(3)
    pts = [(rnd.randint(0, 500) + 200 * (c := rnd.randrange(2)), c) for _ in range(400)]
    # force many buckets: one task may hold at most 50 histogram rows
    assert _run(spark, pts, 2, rows_per_task=50) == _run(spark, pts, 2)


def test_noise_column_has_no_cut(spark):
    rnd = random.Random(11)
    pts = [(rnd.random(), rnd.randrange(2)) for _ in range(200)]
    assert _run(spark, pts, 2) == []


@pytest.fixture
def deadline():
    """Planning cannot be interrupted: the call to the driver is."""

    def late(*_):
        raise TimeoutError("planning did not end")

    old = signal.signal(signal.SIGALRM, late)
    signal.alarm(150)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, old)


def test_ten_classes(spark, deadline):
    rnd = random.Random(5)
    pts = [(rnd.randint(0, 20) + 15 * (c := rnd.randrange(10)), c) for _ in range(400)]
    assert _run(spark, pts, 10) == [float(x) for x in brute_mdl(pts, 10)]
