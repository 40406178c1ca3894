import math
import random
from collections import Counter

import numpy as np

from votesel.llm.langid import START, LanguageModel, Scorer, expect_long, learn_pieces

PIECES = [START, START + "a", "a", "ab", "b", "ba", "abab", "c"]


def model(n_langs):
    rng = np.random.default_rng(3)
    logs = np.log(rng.dirichlet(np.ones(len(PIECES)), n_langs).T)
    return LanguageModel([str(k) for k in range(n_langs)], {p: logs[k] for k, p in enumerate(PIECES)}, np.log(np.full(n_langs, 1e-7)), 4)


def exact_forward(word, probs, unknown):
    """Sums over all segmentations in whole fractions of two integers, without rounding to doubles."""
    from fractions import Fraction

    alpha = [Fraction(1)]
    for j in range(1, len(word) + 1):
        alpha.append(alpha[j - 1] * Fraction(unknown) + sum(alpha[i] * Fraction(probs[word[i:j]]) for i in range(max(0, j - 4), j) if word[i:j] in probs))
    top = alpha[-1]
    return math.log(top.numerator) - math.log(top.denominator)


def test_long_words_sum_the_segmentations_across_every_place():
    rng = random.Random(8)
    for n_langs in (2, 4):
        m = model(n_langs)
        scorer = Scorer(m)
        for size in (41, 90, 400):
            word = START + "".join(rng.choices("abcé", weights=[5, 5, 2, 1], k=size))
            got = scorer.forward_rescaled(word)
            for lang in range(n_langs):
                want = exact_forward(word, {p: float(np.exp(v[lang])) for p, v in m.logs.items()}, float(np.exp(m.unknown[lang])))
                assert abs(got[lang] - want) < 1e-6 * abs(want), (size, lang)
        short = START + "ababcé"
        assert np.allclose(scorer.forward(short), scorer.forward_rescaled(short, every=2))


def test_expected_counts_of_long_words_match_the_short_form():
    """One word under the limit, learned both ways."""
    index, probs = {p: k for k, p in enumerate(PIECES)}, [1 / len(PIECES)] * len(PIECES) + [1e-4]
    word, expected = "abababcab", [0.0] * (len(PIECES) + 1)
    expect_long(START + word, 3, index, 4, probs, expected)
    once, _ = learn_pieces(Counter({word: 3}), PIECES, rounds=1)
    total = sum(expected)
    assert np.allclose(once, np.log([max(e / total, 1e-7) for e in expected[:-1]]))


def test_every_word_of_the_rows_given_is_learned(spark):
    from votesel.llm.langid import learn

    rows = [("a", " ".join("a" * 3 + "bcdefghij"[k % 9] + chr(97 + k % 26) + chr(97 + k // 26 % 26) + chr(97 + k // 676 % 26) + chr(97 + k // 17576) for k in range(35_000)) + " é", "x")]
    got = learn(spark.createDataFrame(rows, "id string, text string, lang string").select("text", "lang"), [START, "é", "a", "ñ"])
    assert got.logs["é"][0] > got.unknown[0] + 1


def test_a_hundred_thousand_letters_without_a_space():
    s = Scorer(model(3))
    n, total = s.evidence("ab" * 50_000)
    assert n == 1 and np.isfinite(total).all() and (total < -1000).all()
