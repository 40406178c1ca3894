"""Quality rules as a short-circuit cascade ordered by rejection per cost.

Each rule looks at one text and says whether it rejects. On a bounded sample every rule runs on every
text; its mean time is its cost, the share it rejects its selectivity. The cascade runs the rules by
decreasing rejection per cost and stops at the first that rejects. The order changes the work, never the
verdict: a text is kept iff no rule rejects it.

Words are maximal runs of bytes outside space and 0x09-0x0D. Null text counts as a text without words.
Repeated rows give repeated results. A text's measures are computed from the whole text.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votesel.llm.common import arrow_schema, text_chunks

#: Fixed value: the symbols that the contract counts.
SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
BULLET = re.compile(rb"[\x20\x09-\x0D]*(?:[-*]|\xe2\x80\xa2)[\x20\x09]")
CONTINUES = bytes(range(0x80, 0xC0))


@dataclass
class Measures:
    """Measures of a text, each computed when a rule first asks for it."""

    raw: bytes
    words: list[bytes] = field(init=False)

    def __post_init__(self) -> None:
        self.words = self.raw.split()  # bytes.split() cuts at space and 0x09-0x0D only

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        joined = b"".join(self.words)
        return len(joined) if joined.isascii() else len(joined.translate(None, CONTINUES))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw.translate(None, NOT_SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines that hold a word."""
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 3-word windows that occur twice or more."""
        n = len(self.words)
        if n < 4:
            return 0
        index: dict[bytes, int] = {}
        ids = np.fromiter((index.setdefault(w, len(index)) for w in self.words), np.int64, n)
        pairs = np.unique(ids[:-1] * len(index) + ids[1:], return_inverse=True)[1]
        _, inverse, counts = np.unique(pairs[:-1] * len(index) + ids[2:], return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[k : n - 2 + k] |= again
        return int(hit.sum())

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


@dataclass(frozen=True)
class Rule:
    """A named rejection test; ``reject`` must depend on the text alone."""

    name: str
    reject: Callable[[Measures], bool]


#: The rules with their production thresholds.
RULES = (
    Rule("base", lambda m: m.base_failed),
    Rule("word_length", lambda m: not 2 <= m.word_chars / max(m.n_words, 1) <= 15),
    Rule("symbol_share", lambda m: m.n_symbols > 0.1 * m.n_words),
    Rule("duplicate_lines", lambda m: len(m.lines) >= 10 and m.n_dup_lines > 0.3 * len(m.lines)),
    Rule("duplicate_line_bytes", lambda m: _repeated_bytes(m.lines) > 0.3 * sum(map(len, m.lines))),
    Rule("top_word_share", lambda m: bool(m.words) and max(Counter(m.words).values()) > 0.3 * m.n_words),
    Rule("bullet_lines", lambda m: bool(m.lines) and sum(1 for x in m.lines if BULLET.match(x)) > 0.9 * len(m.lines)),
    Rule("ellipsis_lines", lambda m: bool(m.lines) and sum(1 for x in m.lines if x.rstrip().endswith((b"...", b"\xe2\x80\xa6"))) > 0.3 * len(m.lines)),
    Rule("letter_words", lambda m: _letter_words(m.words) < 0.6 * m.n_words),
)
LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


def _repeated_bytes(lines: list[bytes]) -> int:
    seen: set[bytes] = set()
    total = 0
    for x in lines:
        if x in seen:
            total += len(x)
        seen.add(x)
    return total


def _letter_words(words: list[bytes]) -> int:
    return sum(1 for w in words if w.isalpha() or LETTER.search(w))


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> list[str]:
    """Rule names by decreasing rejection per second, estimated on about ``sample_rows`` texts: the
    rows whose id's hash falls into that share of its range. The sample only sets the order of the rules."""
    names = [r.name for r in rules]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected = [0.0] * len(rules), [0] * len(rules)
        for chunk in text_chunks(batches):
            for text in chunk["text"]:
                for i, rule in enumerate(rules):
                    m = Measures((text or "").encode())
                    t = time.perf_counter()
                    rejected[i] += bool(rule.reject(m))
                    spent[i] += time.perf_counter() - t
        yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "s": spent, "n": rejected}, schema=arrow_schema("rule long, s double, n long"))

    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    totals = sample.mapInArrow(measure, "rule long, s double, n long").groupBy("rule").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    worth = {names[t.rule]: t.n / max(t.s, 1e-9) for t in totals}
    return sorted(names, key=lambda n: -worth.get(n, 0.0))


def first_rejection(m: Measures, ordered: list[Rule]) -> str | None:
    """Name of the first rule that rejects; the rules behind it don't run."""
    for rule in ordered:
        if rule.reject(m):
            return rule.name
    return None


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` per row.

    One narrow pass after the sample's job; memory bounded by one batch."""
    by_name = {r.name: r for r in rules}
    ordered = [by_name[n] for n in rule_order(docs, rules, sample_rows)]
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            rows = []
            for doc_id, text in zip(chunk["doc_id"], chunk["text"], strict=True):
                m = Measures((text or "").encode())
                kept = first_rejection(m, ordered) is None and not m.base_failed
                rows.append((doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed, kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
