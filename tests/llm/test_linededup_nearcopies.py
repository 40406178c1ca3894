import random
from collections import Counter

import numpy as np

from votesel.llm.common import token_codes, tokens_of
from votesel.llm.linededup import LEAST_WORDS, aligned_lines, dedup_lines, line_report, line_runs
from votesel.llm.nearcopies import cell_table, cells_of, components, dart_signatures, near_copies, possible, star_links, weighted_jaccard

RNG = random.Random(11)
VOCAB = [f"w{i}" for i in range(3000)]


def line(n):
    return " ".join(RNG.choices(VOCAB, k=n))


def brute_runs(text, least):
    """All shortest runs by trying every pair of ends."""
    lines = [(i, x.split()) for i, x in enumerate(text.split("\n")) if x.split()]
    out = set()
    for a in range(len(lines)):
        for b in range(a, len(lines)):
            words = sum(len(w) for _, w in lines[a : b + 1])
            starts = words - len(lines[b][1]) < least
            stops = words - len(lines[a][1]) < least
            if words >= least and (starts or stops):
                out.add((lines[a][0], lines[b][0], words, "\n".join(" ".join(w) for _, w in lines[a : b + 1])))
    return out


def test_runs_match_brute_force():
    for _ in range(200):
        text = "\n".join(line(RNG.choice([0, 1, 3, 8, 25])) for _ in range(RNG.randint(0, 12)))
        assert {r[1:] for r in line_runs(text)} == {r[:3] for r in brute_runs(text, LEAST_WORDS)}


def brute_dedup(docs):
    """Every document against the first holders of its runs, one by one."""
    holder = {}
    for doc_id, text in sorted(docs):
        for first, _, _, run in sorted(brute_runs(text, LEAST_WORDS)):
            holder.setdefault(run, (doc_id, first))
    out = {}
    for doc_id, text in docs:
        anchors = {}
        for first, last, words, run in brute_runs(text, LEAST_WORDS):
            earlier, there = holder[run]
            if earlier < doc_id:
                anchors.setdefault(earlier, []).append((first, last, there, words))
        gone = set().union(*[aligned_lines(a) for a in anchors.values()]) if anchors else set()
        out[doc_id] = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    return out


def test_line_dedup(spark):
    shared, short = [line(12) for _ in range(6)], "All rights reserved."
    texts = {1: [line(9), *shared, line(9), short], 2: [line(30), *shared, line(30), short], 3: [*shared[3:], line(30), *shared[:3], short], 4: [line(40), short], 5: [line(9), *shared, line(9), short]}
    texts[5] = texts[1]
    for k in range(10, 40):
        texts[k] = [RNG.choice(shared) if RNG.random() < 0.4 else line(RNG.choice([0, 4, 25])) for _ in range(14)]
    docs = [(k, "\n".join(v)) for k, v in texts.items()]
    rows = [(k, t, "x", 1) for k, t in docs] + [(None, docs[0][1], "x", 1), (50, None, "x", 1), (51, "", "x", 1), (52, "\n".join([line(30)] * 2) + "\n", "x", 1), (52, docs[0][1], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lines string, first int")
    out = dedup_lines(df).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r.text for r in out if r.doc_id in texts}
    assert got == brute_dedup(docs)
    assert got[1] == docs[0][1] and got[4] == "\n".join(texts[4]) and got[5] == ""
    assert got[2] == "\n".join([texts[2][0], *texts[2][7:]])
    assert next(r.text for r in out if r.doc_id is None) == docs[0][1] and next(r for r in out if r.doc_id == 50).text is None
    assert set(line_report(df).columns) == {"doc_id", "n_lines", "n_removed", "n_partners", "kept_sha256"}
    assert line_report(df.limit(0)).count() == 0


def test_alignment_of_long_documents_is_fast():
    anchors = [(i, i + 1, 20_000 - i, 20) for i in range(20_000)]
    assert len(aligned_lines(anchors)) == 2


def brute_similarity(a, b):
    def bag(t):
        w = tokens_of(t)
        k = min(5, len(w))
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / sum((x | y).values())


def edited(text, share):
    return " ".join(RNG.choice(VOCAB) if RNG.random() < share else w for w in text.split())


def test_cells_give_weighted_jaccard_and_signatures_estimate_it():
    pairs = []
    for _ in range(60):
        a = line(RNG.randint(3, 200)) + " tail" * RNG.randint(0, 20)
        b = edited(a, RNG.choice([0, 0.01, 0.05, 0.2]))
        pairs.append((a, b))
        want = brute_similarity(a, b)
        assert abs(weighted_jaccard(cells_of(token_codes(a)), cells_of(token_codes(b))) - want) < 1e-12
    left = dart_signatures([cells_of(token_codes(a)) for a, _ in pairs], 512)
    right = dart_signatures([cells_of(token_codes(b)) for _, b in pairs], 512)
    error = [(left[i] == right[i]).mean() - brute_similarity(*pairs[i]) for i in range(len(pairs))]
    assert max(map(abs, error)) < 0.12 and abs(np.mean(error)) < 0.02
    alone = dart_signatures([cells_of(token_codes(pairs[3][0]))], 512)
    assert (alone[0] == left[3]).all() and (left != 0).all()


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (20, 30)] + [(100 + i, 101 + i) for i in range(20)]
    links = [(min(x), max(x)) for x in links]
    got = {r.doc_id: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {**dict.fromkeys(range(1, 6), 1), **dict.fromkeys((7, 8, 9), 7), 20: 20, 30: 20, **dict.fromkeys(range(100, 121), 100)}
    assert got == want


def test_near_copies_match_brute_force(spark):
    texts = [line(RNG.randint(60, 150)) for _ in range(12)]
    docs = list(enumerate(texts))
    for k, t in enumerate(texts[:6]):
        docs += [(20 + 10 * k, t.upper() + "!"), (21 + 10 * k, edited(t, 0.015)), (22 + 10 * k, edited(t, 0.015)), (23 + 10 * k, edited(t, 0.4))]
    docs += [(500, "two words"), (501, "Two, words."), (502, "other words"), (503, ""), (504, "!!!"), (505, "a b c d e " * 9000), (506, "a b c d e " * 9000 + "x")]
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, ta) in enumerate(docs):
        for b, tb in docs[i + 1 :]:
            if tokens_of(ta) and tokens_of(tb) and abs(len(ta) - len(tb)) < 400 and brute_similarity(ta, tb) >= 0.8:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    rows = [(d, t, 0, "x") for d, t in docs] + [(600, None, 0, "x"), (None, texts[0], 0, "x"), (0, texts[0], 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id int, label string")
    got = near_copies(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert {d: by[d].class_id for d, _ in docs} == {d: find(d) for d, _ in docs}
    assert by[20].text_id == 0 and by[501].text_id == 500 and by[600].kept and by[None].kept and not by[20].kept
    assert near_copies(df.limit(0)).count() == 0


def test_links_behind_unlike_hubs_are_found(spark):
    """Buckets whose heaviest texts are like no one, and links of members that a hub has already taken."""
    page, other = line(100).split(), line(100).split()
    further = page[:48] + ["x1"] * 1 + page[49:]  # like page, and like nearest
    nearest = further[:20] + ["x2"] + further[21:]
    texts = {1: line(90), 2: line(80), 3: line(70), 4: " ".join(other), 5: " ".join([*other[:99], "x"]), 6: " ".join(page), 7: " ".join(further), 8: " ".join(nearest)}
    assert brute_similarity(texts[6], texts[7]) >= 0.8 and brute_similarity(texts[7], texts[8]) >= 0.8 and brute_similarity(texts[6], texts[8]) < 0.85
    cells = cell_table(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    entries = [(0, d, 100 - d) for d in texts]  # one bucket, unlike texts first
    links, labels = star_links(spark.createDataFrame(entries, "band long, doc_id long, weight long"), cells)
    assert {r.doc_id: r.label for r in labels.collect()} == {4: 4, 5: 4, 6: 6, 7: 6, 8: 6}
    # the hub takes 7 and is not like 8 (at 0.85), which is like 7 only
    links, labels = star_links(spark.createDataFrame([(0, 6, 9), (0, 7, 8), (0, 8, 7)], "band long, doc_id long, weight long"), cells, 0.85)
    assert {r.doc_id: r.label for r in labels.collect()} == {6: 6, 7: 6, 8: 6}
    assert {(r.a, r.b) for r in links.collect()} == {(6, 7), (7, 8)}


def test_bound_keeps_every_similar_pair(spark):
    texts = {2 * k + e: t for k in range(40) for a in [line(RNG.randint(5, 400)) + " tail" * RNG.randint(0, 20)] for e, t in enumerate((a, edited(a, RNG.choice([0.005, 0.02, 0.04, 0.3]))))}
    cells = cell_table(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    pairs = [(2 * k, 2 * k + 1) for k in range(40)]
    kept = {(r.a, r.b) for r in possible(spark.createDataFrame(pairs, "a long, b long"), cells).collect()}
    assert {p for p in pairs if brute_similarity(texts[p[0]], texts[p[1]]) >= 0.8} <= kept and len(kept) < 40
