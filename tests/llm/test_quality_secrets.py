import hashlib
import math
import random
import re
from collections import Counter

from votesel.llm.quality import RULES, Measures, quality_cascade, rule_order
from votesel.llm.secrets import BASE, CLASSES, secret_report

DOCS = "doc_id long, text string, kept string, base string"


def brute_measures(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    hit = {j for i, g in enumerate(grams) if many[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_measures_match_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "é ", " ", "\n", "x\x85y", "\x1c", "|", "# "]) for _ in range(rng.randint(0, 120)))
        m = Measures(text.encode())
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == brute_measures(text), repr(text)


def test_cascade_verdict_is_independent_of_order(spark):
    good = " ".join(f"word{chr(97 + i % 26)}{i} tail{i}" for i in range(60))
    rows = [(1, good, "x", "x"), (1, good, "x", "x"), (2, None, "x", "x"), (3, "", None, None), (4, good + " |#*" * 30, "x", "x"), (None, good, "x", "x"), (5, "same words again " * 40_000, "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in quality_cascade(docs).collect()}
    assert got[1].kept and got[None].kept and not got[2].kept and not got[3].kept and not got[4].kept
    assert not got[4].base_failed and got[5].base_failed and got[2].n_words == 0
    backwards = {r.doc_id: r.kept for r in quality_cascade(docs, rules=RULES[::-1], sample_rows=1).collect()}
    assert backwards == {k: r.kept for k, r in got.items()}
    assert sorted(rule_order(docs)) == sorted(r.name for r in RULES)
    assert quality_cascade(docs.limit(0)).count() == 0


def brute_spans(text):
    spans = []
    for k, (_, _, group, least) in enumerate(BASE):
        rx = [r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+"][k]
        spans += [(m.start(), k, m.end()) for m in re.finditer(rx, text) if len(m[2 if group else 0]) >= least]
    return sorted(spans)


def windows(text, span, cls):
    """Positions covered by windows of the class whose entropy reaches the threshold, each from scratch."""
    out = set()
    for i in range(span[0], span[1] - cls.window + 1):
        n = Counter(text[i : i + cls.window])
        if -sum(v / cls.window * math.log2(v / cls.window) for v in n.values()) >= cls.bits - 1e-9:
            out |= {*range(i, i + cls.window)}
    return out


def test_secrets_match_brute_force(spark):
    rng = random.Random(5)
    pieces = ["password=", "Token: '", "api_key\":\"", "abcdef0123456789ab", "AKIA", "ABCDEFGH12345678", "é", " ", "\n", "x.y=", "secret", "z" * 12, "0f" * 9, "AKIA" + "Q7" * 8]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    texts += ["", "password=x.secret:abcdefghijklmnop", "ſecret=abcdefghijklmnop", "é" * 50_000 + " password = " + "q" * 40]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)] + [(-1, None, None, None)], DOCS)
    got = {r.doc_id: r for r in secret_report(docs).collect()}
    assert got[-1].spans == "" and len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        want = brute_spans(t)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[1] == k for s in want) for k in range(3)), repr(t)
        joined = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), repr(t)
        assert {x for x in joined.split(",") if x} <= set(got[i].spans.split(","))


def test_entropy_spans_and_allow_list(spark):
    rng = random.Random(7)
    key = "".join(rng.choice(CLASSES[0].symbols[:62]) for _ in range(60))
    half = "z" * 30 + key
    rows = [(1, f"see {key} end"), (2, "the Donaudampfschifffahrtsgesellschaftskapitaen"), (3, "id 123e4567-e89b-12d3-a456-426614174000"), (4, f"pad {half} pad"), (5, f"token={key}"), (6, "see example" + key)]
    got = {r.doc_id: r.spans for r in secret_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "entropy64:4:64" and got[2] == "" and "entropy" not in got[3] and got[6] == ""
    covered = windows(rows[3][1], (4, 94), CLASSES[0])
    assert got[4] == f"entropy64:{min(covered)}:{max(covered) + 1}" and 4 < min(covered) < 34
    assert got[5].startswith("assign:0:") and "entropy" not in got[5]
