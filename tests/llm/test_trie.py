import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from votesel.llm.trie import last_turns, prefix_trie, shared_heads, turn_lists

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
CHATS = "conv_id long, turn long, role string, text string, node string, key int"


def turn_key(role, text):
    """The order of turns with equal numbers: their digests."""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows, rebuild=True):
    """The trie from lists of every prefix, literally."""
    own = defaultdict(list)
    for c, n, r, x, *_ in rows:
        if c is not None:
            own[c].append((n is not None, n or 0, turn_key(r or "", x or ""), r or "", x or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    convs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        convs[c] = tuple(own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + ts[h:]) if rebuild else tuple(ts)
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    out = []
    for p, ms in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        leaves = sum(not any(len(x) == len(q) + 1 and x[:-1] == q for x in members) for q in below)
        ends = ",".join(str(c) for c in sorted(ms) if len(convs[c]) == len(p))
        out.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def chats(rng):
    """Copies, shared heads, lengths around the block width and far beyond, repeated turns, nulls."""
    texts = ["hi", "hé 𝔘", "", None, "go on", "w" * 500]
    long = [(i, rng.choice(["user", "assistant", None]), rng.choice(texts)) for i in range(70)]
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 215), -7, 10**12]:
        n = rng.choice([1, 2, 3, 7, 8, 9, 16, 17, 24, 40])
        own = long[:n] if rng.random() < 0.6 else long[: n // 2] + [(i, "user", rng.choice(texts)) for i in range(n // 2, n)]
        rows += [(c, i, r, t, "x", 1) for i, r, t in own]
    rows += [(777701 + c, 0, "user", "alone", "x", 1) for c in range(12)]  # no first conversation: turnless if h > 0
    rows += [(300 + c, i, "user", "same", "x", 2) for c in range(40) for i in range(8)]
    rows += [(5, None, "system", "first", None, None), (5, None, None, None, "", 0), (6, 0, "user", "again", "x", 1), (6, 0, "user", "again", "x", 1), (None, 0, "user", "lost", "x", 1)]
    rng.shuffle(rows)
    return rows


def test_trie_matches_brute_force(spark):
    rows = chats(random.Random(12))
    table = spark.createDataFrame(rows, CHATS).repartition(5)
    got = prefix_trie(shared_heads(turn_lists(table))).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_plain_lists_texts_and_many_ends(spark):
    """The operator on conversations as they are; a node with over 512 ends; texts of nodes."""
    rows = [(c, t, "user", f"t{t}", "", 0) for c in range(-700, 1500) for t in range(2)] + [(c, 0, "user", f"own {c}", "", 0) for c in range(2000, 2030)]
    table = spark.createDataFrame(rows, CHATS)
    nodes = prefix_trie(turn_lists(table))
    assert sorted((tuple(r) for r in nodes.select(*COLUMNS).collect()), key=str) == brute(rows, rebuild=False)
    said = {(r.depth, r.conv_id): r.text for r in last_turns(nodes, table).where("conv_id < 2000").collect()}
    assert said == {(0, -700): None, (1, -700): "t0", (2, -700): "t1"}


def test_empty_and_turnless(spark):
    table = spark.createDataFrame(chats(random.Random(1))[:3], CHATS)
    assert prefix_trie(turn_lists(table.limit(0))).count() == 0
    bare = spark.createDataFrame([(4,), (9,)], "conv_id long").withColumn("turns", F.array().cast("array<binary>"))
    assert [tuple(r) for r in prefix_trie(bare).select(*COLUMNS).collect()] == [(4, 0, None, 2, 0, 1, 0, hashlib.sha256(b"4,9").hexdigest())]
