import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from votesel.llm.common import token_codes, tokens_of
from votesel.llm.decontam import LEAST_SHARE, LEAST_TOKENS, MASKS, SPAN, BenchmarkIndex, find_leaks
from votesel.llm.langid import MAX_WORD, START, LanguageModel, Scorer, learn_pieces, predict_languages, train_on_split
from votesel.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def segmentations(word, pieces):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            for rest in segmentations(word[k:], pieces):
                yield [word[:k], *rest]


def test_forward_sums_all_segmentations():
    rng = random.Random(1)
    for n_langs in (2, 4):
        pieces = [START, START + "a", "a", "b", "ab", "ba", "aba", "bb"]
        logs = {p: np.log([rng.random() for _ in range(n_langs)]) for p in pieces}
        scorer = Scorer(LanguageModel([str(i) for i in range(n_langs)], logs, np.full(n_langs, -700.0), 3))
        for word in ("a", "ab", "abab", "bbaba"):
            got = scorer.forward(START + word)
            for lang in range(n_langs):
                want = math.log(sum(math.prod(math.exp(logs[p][lang]) for p in s) for s in segmentations(START + word, set(pieces))))
                assert abs(got[lang] - want) < 1e-9


def test_learning_raises_likelihood():
    from collections import Counter

    counts = Counter({"abab": 5, "ab": 9, "ba": 1})
    pieces = [START, "a", "b", "ab", START + "ab"]
    logs, other = learn_pieces(counts, pieces, rounds=1)
    more, _ = learn_pieces(counts, pieces, rounds=6)

    def total(v):
        s = Scorer(LanguageModel(["x"], {p: np.array([v[i]]) for i, p in enumerate(pieces)}, np.array([other]), 3))
        return sum(n * s.forward(START + w)[0] for w, n in counts.items())

    assert total(more) >= total(logs) and abs(np.exp(more).sum() - 1) < 1e-3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = QUERIES["op8_langid"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_language_edge_cases(spark):
    train = [(i, t, lang, "s") for i, (t, lang) in enumerate([("the house and the tree", "en"), ("das haus und der baum", "de")] * 40)]
    docs = spark.createDataFrame(train + [(1000, None, "en", "s"), (1001, "123 !!", "de", "s"), (1002, "", None, "s"), (None, "the tree", None, None), (1003, "the tree " * 50_000, None, "s"), (1003, "the tree", None, "s")], "doc_id long, text string, lang string, score string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in predict_languages(docs, train_on_split(docs)).where("doc_id is null or doc_id >= 1000").collect()]
    assert len(got) == 6 and {g[:2] for g in got} == {(1000, "und"), (1001, "und"), (1002, "und"), (None, "en"), (1003, "en")}
    assert all(0 <= s <= 1 for _, _, s in got)
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in predict_languages(nothing, train_on_split(nothing)).collect()} == {"und"}
    assert predict_languages(docs.limit(0), train_on_split(docs.limit(0))).count() == 0


def test_rare_language_is_learned_beside_a_large_one(spark):
    many = spark.range(40_000).selectExpr("id AS doc_id", "'the house and the tree' AS text", "'en' AS lang")
    few = spark.createDataFrame([(100_000 + i, "das haus und der baum", "de") for i in range(12)], "doc_id long, text string, lang string")
    docs = many.unionByName(few)
    model = train_on_split(docs, sample_rows=100, least_rows=50)
    assert model.langs == ["de", "en"]
    assert {(r.lang, r.lang_pred) for r in predict_languages(docs, model).join(docs, "doc_id").select("lang", "lang_pred").distinct().collect()} == {("de", "de"), ("en", "en")}


def test_long_runs_of_letters_are_learned_to_their_end():
    from collections import Counter

    pieces = [START, "a", "b"]
    logs, other = learn_pieces(Counter({"a" * MAX_WORD + "b" * 2 * MAX_WORD: 1}), pieces, rounds=2)
    assert logs[2] > logs[1] > other


def brute_leaks(text, items):
    """Items with a stretch of enough equal tokens on some diagonal, over all diagonals."""
    doc, out = tokens_of(text), set()
    for item_id, t in items:
        own = tokens_of(t)
        for shift in range(-len(own) + 1, len(doc)):
            lo, hi = max(0, -shift), min(len(own), len(doc) - shift)
            same = [own[i] == doc[i + shift] for i in range(lo, hi)]
            if len(same) >= min(LEAST_TOKENS, len(own)) and len(same) and sum(same) >= LEAST_SHARE * len(same):
                out.add(item_id)
    return out


def test_leaks_match_brute_force():
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(14, 40)))) for k in range(8)]
    index = BenchmarkIndex(items)
    for _ in range(60):
        item = rng.choice(items)[1].split()
        text = " ".join(rng.choices(vocab, k=30) + item + rng.choices(vocab, k=30)).upper() if rng.random() < 0.7 else " ".join(rng.choices(vocab, k=90))
        assert {x[0] for x in index.leaks(token_codes(text))} == brute_leaks(text, items)


def test_substituted_leaks_are_found():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(4000)]
    found = 0
    for _ in range(500):
        item = rng.choices(vocab, k=20)
        leak = list(item)
        for i in rng.sample(range(20), 4):
            leak[i] = "changed"
        text = " ".join(rng.choices(vocab, k=20) + leak + rng.choices(vocab, k=20))
        found += bool(BenchmarkIndex([(1, " ".join(item))]).leaks(token_codes(text)))
    assert found >= 490


def test_masks_miss_no_substitutions():
    """Every placing of as many substitutions as a stretch may have, up to twice the shortest leak less one."""
    masks = [sum(1 << k for k, bit in enumerate(m) if bit == "1") for m in MASKS]
    assert max(map(len, MASKS)) <= SPAN
    for n in range(SPAN, 2 * LEAST_TOKENS):
        equal = np.array([(1 << n) - 1 - sum(1 << i for i in c) for c in itertools.combinations(range(n), int(n * (1 - LEAST_SHARE)))])
        hit = np.zeros(len(equal), bool)
        for mask in masks:
            for at in range(n - mask.bit_length() + 1):
                hit |= equal & (mask << at) == mask << at
        assert hit.all(), n


def test_regular_substitutions_are_found():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(4000)]
    for every in range(4, 11):
        for phase in range(every):
            for size in (40, 200):
                item = rng.choices(vocab, k=size)
                leak = ["changed" if i % every == phase else w for i, w in enumerate(item)]
                text = " ".join(rng.choices(vocab, k=20) + leak + rng.choices(vocab, k=20))
                items = [(1, " ".join(item))]
                assert {x[0] for x in BenchmarkIndex(items).leaks(token_codes(text))} == brute_leaks(text, items) == {1}


def brute_stretches(text, items):
    """Items with a long and equal enough stretch, over all diagonals and all their stretches."""
    doc, out = tokens_of(text), set()
    for item_id, t in items:
        own = tokens_of(t)
        least = min(LEAST_TOKENS, len(own))
        for shift in range(-len(own) + 1, len(doc)):
            lo, hi = max(0, -shift), min(len(own), len(doc) - shift)
            sums = [0, *itertools.accumulate(own[i] == doc[i + shift] for i in range(lo, hi))]
            if any(sums[b] - sums[a] >= LEAST_SHARE * (b - a) for a in range(len(sums)) for b in range(a + least, len(sums))):
                out.add(item_id)
    return out


def test_substituted_excerpts_match_all_stretches():
    rng = random.Random(10)
    vocab = [f"w{i}" for i in range(400)]
    found = 0
    for _ in range(150):
        items = [(k, " ".join(rng.choices(vocab, k=rng.randint(10, 59)))) for k in range(3)]
        own = items[1][1].split()
        size = rng.randint(min(10, len(own)), len(own))
        at = rng.randint(0, len(own) - size)
        leak = own[at : at + size]
        for i in rng.sample(range(size), rng.choice([size // 5, size // 4, size // 4 + 1])):
            leak[i] = "changed"
        text = " ".join(rng.choices(vocab, k=20) + leak + rng.choices(vocab, k=20))
        got = BenchmarkIndex(items).leaks(token_codes(text))
        assert {x[0] for x in got} == brute_stretches(text, items)
        assert all(n >= min(LEAST_TOKENS, len(items[k][1].split())) and same >= LEAST_SHARE * n for k, _, n, same in got)
        found += bool(got)
    assert 75 < found < 150


def test_leaks_operator(spark):
    passage = " ".join(f"token{i}" for i in range(20))
    bench = spark.createDataFrame([(1, passage, "x"), (2, None, "x"), (3, "", "x"), (None, passage, "x"), (4, "only three words", "x"), (5, passage.replace("token", "other"), "x"), (5, passage.replace("token", "other"), "x")], "item_id long, text string, doc_id string")
    rows = [(1, "a b c " + passage + " d", 0), (1, "a b c " + passage + " d", 0), (2, None, 0), (3, "", 0), (None, passage, 0), (4, "x " * 100_000 + passage.replace("token", "other"), 0), (5, "it has only three words in it", 0), (6, " ".join(passage.split()[:10]), 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    want = sorted([(1, 1), (1, 1), (-1, 1), (4, 5), (5, 4)])
    for block in (5000, 2):
        got = find_leaks(docs, bench, block_items=block).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in got) == want
    assert find_leaks(docs.limit(0), bench).count() == 0 and find_leaks(docs, bench.limit(0)).count() == 0


def test_items_of_few_words_leak_only_as_whole_documents():
    index = BenchmarkIndex([(1, "Yes"), (2, "the year"), (3, "capital of France")])

    def leaked(text):
        return [x[0] for x in index.leaks(token_codes(text))]

    assert leaked("yes!") == [1] and leaked("The year?") == [2]
    assert leaked("Yes, it was the year of the flood.") == []
    assert leaked("He saw the capital of France, yes.") == [3]
    assert leaked("") == [] and leaked("capital of") == []
