"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over consecutive token positions; positions outside the mask are ignored, so two windows
that differ only there hash alike. All windows of the benchmark are hashed under every mask; a document's
windows are hashed the same way and joined with them. Around each hit the document and the item are laid
side by side (no gaps) over their whole overlap, and equal tokens are counted: it is a leak when any stretch
of the overlap is long enough and nearly equal, whatever single tokens were substituted.

Tokens are maximal runs of word characters in lower case. Null and empty texts have no tokens and match
nothing. Items with fewer tokens than a window are matched as a whole, by equality; those under
``LEAST_ITEM`` tokens ("Yes") are ordinary words in any text, so only a document that is the item and
nothing else is their leak. Repeated rows give repeated results; an item with null id is ignored, a document with null id is reported under null.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votesel.llm.common import arrow_schema, text_chunks, token_codes

#: Masks of weight 5. Together they miss no leak: wherever the substitutions of a stretch of 10 to 25 tokens
#: with the least share lie, regular or not, some window under some mask is intact (the tests try them all),
#: and of a longer stretch one half has the share as well.
MASKS = ("111011", "1100001011", "11010101", "111000011", "11011001")
SPAN = 10
#: A leak: a stretch of at least this many tokens of which at least this share is equal.
LEAST_TOKENS, LEAST_SHARE = 13, 0.75
#: Items with fewer tokens leak only as a whole document.
LEAST_ITEM = 3
_PER_UNEQUAL = round(1 / (1 - LEAST_SHARE))
_MUL = np.uint64(0x9E3779B97F4A7C15)


def seed_hashes(codes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of every window of ``codes`` under a mask."""
    n = len(codes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            h *= _MUL
            h ^= codes[k : k + n]
            h ^= h >> np.uint64(29)
    return h * _MUL


class BenchmarkIndex:
    """Seed hashes of one bounded block of benchmark items, with a bit table that rules out most windows."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...] = MASKS):
        self.masks = masks
        self.codes: list[np.ndarray] = []
        self.ids: list[int] = []
        found: list[dict[int, list[tuple[int, int]]]] = [defaultdict(list) for _ in masks]
        self.short: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for item_id, text in items:
            codes = token_codes(text)
            if len(codes) == 0:
                continue
            at = len(self.ids)
            self.ids.append(item_id)
            self.codes.append(codes)
            if len(codes) < SPAN:
                self.short[tuple(int(c) for c in codes)].append(at)
            for m, mask in enumerate(masks):
                for pos, h in enumerate(seed_hashes(codes, mask)):
                    found[m][int(h)].append((at, pos))
        self.found = found
        self.shift = np.uint64(64 - 20)
        self.bits = []
        for f in found:
            bits = np.zeros(1 << 20, bool)
            bits[(np.fromiter(f, np.uint64, len(f)) >> self.shift).astype(np.int64)] = True
            self.bits.append(bits)
        self.short_sizes = sorted({len(k) for k in self.short})
        self.short_first = {k[0] for k in self.short}

    def diagonals(self, codes: np.ndarray) -> set[tuple[int, int]]:
        """(item, document position of the item's first token) of every seed hit."""
        hits: set[tuple[int, int]] = set()
        for bits, found, mask in zip(self.bits, self.found, self.masks, strict=True):
            h = seed_hashes(codes, mask)
            for p in np.flatnonzero(bits[(h >> self.shift).astype(np.int64)]):
                for item, pos in found.get(int(h[p]), ()):
                    hits.add((item, int(p) - pos))
        return hits

    def leaks(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item id, start token, tokens, equal tokens) of the best verified stretch per item."""
        best: dict[int, tuple[int, int, int]] = {}
        for item, shift in self.diagonals(codes):
            own = self.codes[item]
            lo, hi = max(0, -shift), min(len(own), len(codes) - shift)
            equal = own[lo:hi] == codes[lo + shift : hi + shift]
            stretch = best_stretch(equal, min(LEAST_TOKENS, len(own)))
            if stretch:
                start, size, same = stretch
                key = (same, -(lo + shift + start), size)
                item_id = self.ids[item]
                if item_id not in best or key > (best[item_id][2], -best[item_id][0], best[item_id][1]):
                    best[item_id] = (lo + shift + start, size, same)
        for size in self.short_sizes:
            if size < LEAST_ITEM and size != len(codes):
                continue
            for p in range(len(codes) - size + 1):
                if int(codes[p]) in self.short_first:
                    for item in self.short.get(tuple(int(c) for c in codes[p : p + size]), ()):
                        best.setdefault(self.ids[item], (p, size, size))
        return [(k, *v) for k, v in sorted(best.items())]


def best_stretch(equal: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """(start, size, equal tokens) of the stretch with the highest sum of +1 per equal and -3 per unequal
    token among all stretches of at least ``least`` tokens, if it is equal enough.

    The sum is negative exactly where the share of equal tokens is under 3 in 4, so a stretch is found
    whenever there is one. One pass over running sums: the best start for an end is the lowest sum at least
    ``least`` tokens before it."""
    if len(equal) < least:
        return None
    sums = np.concatenate(([0], np.cumsum(np.where(equal, 1, 1 - _PER_UNEQUAL))))
    score = sums[least:] - np.minimum.accumulate(sums[: len(sums) - least])
    end = int(np.argmax(score))
    if score[end] < 0:
        return None
    start = end - int(np.argmin(sums[: end + 1][::-1]))
    end += least
    return start, end - start, int(equal[start:end].sum())


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_items: int = 5000) -> DataFrame:
    """``doc_id, item_id, start_token, n_tokens, n_equal``: one row per document and leaked item.

    The benchmark is taken in blocks of at most ``block_items`` items; each block's index is broadcast and
    meets all documents in one narrow pass, so neither side is shuffled and a block's size is bounded
    however large the benchmark is. Windows of the documents are never shipped."""
    schema = "doc_id long, item_id long, start_token long, n_tokens long, n_equal long"
    arrow = arrow_schema(schema)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    parts, last = [], None
    while True:
        ahead = items if last is None else items.where(F.struct("item_id", "text") > F.struct(F.lit(last[0]).cast("long"), F.lit(last[1])))
        block = [(r.item_id, r.text) for r in ahead.distinct().orderBy("item_id", "text").limit(block_items).collect()]
        if not block:
            break
        last = block[-1]
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = BenchmarkIndex(shared.value)
            for chunk in text_chunks(batches):
                out = [(d, *leak) for d, text in zip(chunk["doc_id"], chunk["text"], strict=True) for leak in index.leaks(token_codes(text))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

        parts.append(rows.mapInArrow(run, schema))
        if len(block) < block_items:
            break
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
