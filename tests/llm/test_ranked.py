import math
import random
from collections import Counter

import numpy as np
import pytest

from votesel.llm import ranked
from votesel.llm.ranked import BestOf, DocumentTree, ranked_search, terms_of


def brute(docs, items, k=50):
    """Every document scored for every item, literally."""
    bags = [(d, terms_of(t)) for d, t in docs if terms_of(t)]
    N, L = len(bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, terms in asked.items():
        rows = []
        for d, bag in bags:
            tf, m = Counter(bag), 50 + 50 * len(bag) * N // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in terms if tf[t])
            if score > 0:
                rows.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def words(rng, n):
    return " ".join(f"w{int(rng.paretovariate(0.5)) % 90}" for _ in range(n))


@pytest.mark.parametrize("tree_docs, tree_entries, per_pass", [(30_000, 3_000_000, 2_000), (7, 40, 3)])
def test_search_matches_brute_force(spark, monkeypatch, tree_docs, tree_entries, per_pass):
    """Ties, copies, repeated ids and items, nulls, empty texts, one very long text, many small trees and passes."""
    monkeypatch.setattr(ranked, "TREE_DOCS", tree_docs)
    monkeypatch.setattr(ranked, "TREE_ENTRIES", tree_entries)
    monkeypatch.setattr(ranked, "QUERIES_PER_PASS", per_pass)
    rng = random.Random(11)
    docs = [(i, words(rng, rng.randint(0, 60))) for i in range(400)] + [(1000 + i, "W1 w2, W3_w4 w5") for i in range(70)]
    docs += [(3, "w1 w2"), (None, "w1 w2 w3"), (None, None), (500, None), (501, ""), (502, " .,;"), (503, "É é w1 𝔘w2 w7 " * 30_000)]
    items = [(i, words(rng, rng.randint(1, 25))) for i in range(12)] + [(20, "w1"), (20, "w2"), (21, None), (22, "nowhere at all"), (23, ""), (None, "é w3"), (24, "𝔘W2")]
    table = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, score string, rank int").repartition(3)
    got = ranked_search(table, spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, n int"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search(docs.limit(0), items).count() == 0 and ranked_search(docs, items.limit(0)).count() == 0


def test_tree_bounds_and_pruning():
    """Runs, bounds and subtree ends of every node against the documents; the search leaves most documents unscored."""
    rng = random.Random(5)
    vectors = [sorted(rng.sample(range(40), rng.randint(0, 12)), key=int) for _ in range(3000)]
    size = np.array([len(v) for v in vectors])
    tfs = np.array([rng.randint(1, 4) for v in vectors for _ in v], np.int64)
    m = np.array([rng.randint(50, 200) for _ in vectors], np.int64)
    tree = DocumentTree(list(range(3000)), m, np.r_[0, np.cumsum(size)], np.array([t for v in vectors for t in v], np.int64), tfs)
    for v in range(len(tree.label)):
        run = range(int(tree.first[v]), int(tree.last[v]))
        entries = [(d, e) for d in run for e in range(tree.at[d], tree.at[d + 1]) if tree.ranks[e] == tree.label[v]]
        assert len(entries) == len(run) and tree.tf[v] == max(tree.tfs[e] for _, e in entries) and tree.least[v] == min(tree.m[d] for d in run)
        assert tree.end[v] == len(tree.label) or tree.first[tree.end[v]] >= tree.last[v]
    scored = []
    plain = tree.scores
    tree.scores = lambda docs, w: scored.append(len(docs)) or plain(docs, w)
    weights = np.zeros(40, np.int64)
    weights[[20, 25, 31, 38]] = [900, 1500, 2500, 4000]
    best = BestOf(5)
    tree.search([20, 25, 31, 38], weights, best)
    every = plain(np.arange(3000), weights)
    assert sorted(s for _, s in best.rows()) == sorted(every.tolist())[-5:] and sum(scored) < 1000
