import random
from itertools import combinations

import numpy as np

from votesel.llm.nearcopies import cell_table, cells_of, prefix_pairs, token_codes, weighted_jaccard


def test_no_pair_is_lost_and_templates_do_not_meet(spark):
    """Against all pairs: every pair at 0.8 or more of different components is a candidate; pages that share
    three quarters with a template but not with each other make almost none."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 4000)}"
    frame = [word() for _ in range(90)]
    texts = [frame + [f"own{i}x{k}" for k in range(28)] for i in range(60)]
    for _ in range(40):
        base = [word() for _ in range(rng.choice([6, 20, 80, 200]))]
        texts.append(base)
        for _ in range(2):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    cells = cell_table(spark.createDataFrame(rows, "doc_id long, text string"))
    own = {i: i - i % 2 if i >= 60 else i for i, _ in rows}
    got = {(r.a, r.b) for r in prefix_pairs(spark.createDataFrame(list(own.items()), "doc_id long, own long"), cells).collect()}
    held = {i: cells_of(token_codes(t)) for i, t in rows}
    like = {(a, b) for a, b in combinations(range(len(rows)), 2) if own[a] != own[b] and weighted_jaccard(held[a], held[b]) >= 0.8}
    assert len(like) > 20 and like <= got
    assert sum(a < 60 and b < 60 for a, b in got) == 0 and all(own[a] != own[b] for a, b in got)
    assert np.all([a < b for a, b in got])
