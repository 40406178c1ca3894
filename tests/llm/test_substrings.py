import hashlib
import random

import numpy as np
import pytest

from votesel.llm.substrings import GRAM, WIDTH, phrases_of, remove_repeats, string_hashes

RNG = random.Random(13)


def text(n, alphabet="abcdefghij éü"):
    return "".join(RNG.choice(alphabet) for _ in range(n))


def brute(docs):
    """Every string of every document against all strings of documents with smaller ids."""
    first = {}
    for doc_id, t in docs:
        if doc_id is not None and t is not None:
            data = t.encode()
            for i in range(len(data) - WIDTH + 1):
                s = data[i : i + WIDTH]
                first[s] = min(first.get(s, doc_id), doc_id)
    out = []
    for doc_id, t in docs:
        data = (t or "").encode()
        gone = bytearray(len(data) + 1)
        if doc_id is not None:
            for i in range(len(data) - WIDTH + 1):
                if first[data[i : i + WIDTH]] < doc_id:
                    gone[i : i + WIDTH] = b"\1" * WIDTH
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(data)))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_hashes_name_strings():
    data = np.frombuffer(text(500, "ab").encode(), np.uint8)
    for size in (1, 2, 3, GRAM, WIDTH):
        h = string_hashes(data, size, 0xD6E8FEB86659FD93)
        assert len(h) == len(data) - size + 1
        names = {}
        for i, x in enumerate(h.tolist()):
            assert names.setdefault(data[i : i + size].tobytes(), x) == x
        assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("alphabet", ["abcdefghij éü", "ab", "a"])
def test_equal_strings_have_equal_triggers(alphabet):
    core = text(WIDTH, alphabet)
    seen = set()
    for _ in range(20):
        left, right = text(RNG.randint(0, 60), alphabet).encode(), text(RNG.randint(0, 60), alphabet).encode()
        data = np.frombuffer(left + core.encode() + right, np.uint8)
        trigger, _, start, n = phrases_of(data)
        assert n.sum() == len(data) - WIDTH + 1 and (np.diff(start) == n[:-1]).all()
        k = np.searchsorted(start, len(left), side="right") - 1
        seen.add(int(trigger[k]))
    assert len(seen) == 1


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, data string")
    got = sorted([tuple(r) for r in remove_repeats(df).collect()], key=str)
    assert got == sorted(brute(rows), key=str)


def test_matches_brute_force(spark):
    passages = [text(RNG.randint(40, 300)) for _ in range(8)]
    docs = [(None, passages[7]), (3000, None), (3001, ""), (3002, "short"), (3003, text(WIDTH)), (3003, passages[0] + "x")]
    for k in RNG.sample(range(2000), 150):
        parts = []
        for _ in range(RNG.randint(1, 5)):
            p = RNG.choice(passages)
            a = RNG.randint(0, len(p) // 2)
            parts += [text(RNG.randint(0, 80)), p[a : a + RNG.randint(10, 300)] if RNG.random() < 0.6 else p]
        docs.append((k, "".join(parts)))
    docs += [(2500 + k, docs[20 + k][1]) for k in range(10)] + [(2600, docs[30][1][:70] + "!" + docs[30][1][71:]), (2601, "z" * 400), (2602, "z" * 120 + "y"), (2603, "ab" * 300), (2604, "b" + "ab" * 60), (3003, text(WIDTH))]
    docs.append((2700, passages[0] * 300))
    check(spark, docs)


def test_low_entropy_and_empty(spark):
    check(spark, [(k, text(RNG.randint(0, 300), "ab" if k % 2 else "aaaaaaab")) for k in range(120)])
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
