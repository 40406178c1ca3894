import random

import corpus_pipeline
from votesel.llm.linededup import LEAST_WORDS, aligned_lines, dedup_lines, line_runs

RNG = random.Random(23)
VOCAB = [f"w{i}" for i in range(4000)]


def line(n):
    return " ".join(RNG.choices(VOCAB, k=n))


def against_all(docs):
    """Every document against the first holders of its runs, and against every earlier document."""
    runs = {d: line_runs(t, LEAST_WORDS) for d, t in docs}
    out = {}
    for doc_id, text in docs:
        by_first, gone = {}, set()
        for run, first, last, words in runs[doc_id]:
            earlier, there = min((d, f) for d, own in runs.items() for r, f, _, _ in own if r == run)
            if earlier < doc_id:
                by_first.setdefault(earlier, []).append((first, last, there, words))
        pairs = list(by_first.values())
        for other, own in runs.items():
            if other < doc_id:
                places = {}
                for r, f, _, _ in own:
                    places[r] = min(f, places.get(r, f))
                pairs.append([(f, last, places[r], w) for r, f, last, w in runs[doc_id] if r in places])
        for anchors in pairs:
            gone |= aligned_lines(anchors) if anchors else set()
        out[doc_id] = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    return out


def test_blocks_that_cross_in_the_first_holder(spark):
    w, x = line(30), line(30)
    docs = [(1, f"{w}\n{line(25)}\n{x}"), (2, f"{x}\n{line(25)}\n{w}"), (3, f"{x}\n{line(25)}\n{w}"), (4, line(40))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in dedup_lines(df, all_holders=True).collect()}
    assert got[3].text == docs[2][1].split("\n")[1] and got[3]._removed == 2
    assert got[2]._removed == 1 and got[1].text == docs[0][1] and got[4].text == docs[3][1]
    assert {r.doc_id: r._removed for r in dedup_lines(df).collect()}[3] == 1


def test_all_holders_match_alignment_of_all_pairs(spark):
    shared = [line(RNG.choice([12, 24, 30])) for _ in range(9)]
    docs = []
    for k in range(45):
        some = RNG.sample(shared, RNG.randint(2, 7))
        docs.append((k * 3, "\n".join(y for s in some for y in ([s, line(6)] if RNG.random() < 0.3 else [s]))))
    docs += [(900 + k, docs[k][1]) for k in range(8)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), all_holders=True).collect()}
    assert got == against_all(docs)


def test_input_columns_with_the_operators_names(spark):
    a, b = line(40), line(35)
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id int, _gone int, _n int, _lines int, _found int, row int, gone int, _removed int, n_partners int, text_hash int"
    extra = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)
    df = spark.createDataFrame([(1, f"{a}\n{b}", "en", "s", 1, *extra), (2, f"{line(30)}\n{a}", "en", "s", 1, *extra), (3, None, None, None, None, *extra)], schema)
    out = {r.doc_id: r for r in dedup_lines(df, all_holders=True).collect()}
    assert out[2]["__removed"] == 1 and out[2]["__lines"] == 2 and tuple(out[2])[5:15] == extra and a not in out[2].text
    for stage in (corpus_pipeline.language_id, corpus_pipeline.line_dedup):
        kept = stage(spark, df, "")
        assert kept.columns == df.columns
        assert all(tuple(r)[5:] == extra for r in kept.collect())
