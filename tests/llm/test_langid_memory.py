import random
import tracemalloc
from collections import Counter

from votesel.llm.langid import START, learn_pieces


def test_arcs_of_many_words_stay_small():
    """What learning holds for a word is a few bytes for each piece inside it."""
    rng = random.Random(8)
    letters = "abcdef"
    pieces = sorted({START + x for x in letters} | {x + y + z for x in letters for y in ["", *letters] for z in ["", *letters]})
    counts = Counter("".join(rng.choice(letters) for _ in range(12)) + str(i) for i in range(4000))
    tracemalloc.start()
    learn_pieces(counts, pieces, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_000 * len(counts), peak / len(counts)
