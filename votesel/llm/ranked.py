"""Ranked lexical search: the best documents of each query, by branch-and-bound over document FP-trees.

Every document is restricted to the terms of the queries and its terms are put in order of document
frequency, the most frequent first. A task gathers its documents into blocks; the sorted vectors of a block
share their prefixes, so they form a trie (an FP-tree): a node is a term behind the path of more frequent
ones and stands for a run of the sorted documents. A node keeps the largest tf of its term among its
documents and the least length norm ``m`` of them, so ``w * ((10^9 tf) div (1000 tf + 20 m))`` of these two
bounds what the term adds to any document below.

A query sees only the nodes of its own terms (one header list per term). The sum of the bounds on the way
to a node bounds every document that ends there, and the largest such sum in a node's subtree bounds the
subtree. The search goes depth first, best child first, leaves a subtree whose bound does not reach the
worst of the best ``k`` so far, and scores the documents it meets exactly. A task hands on its best ``k`` of
each query; the last ranking joins the tasks'.

Terms are maximal runs of letters and digits of ASCII and of all other characters beyond it, A-Z in lower
case. N counts the documents with a term, L their terms. Weights are
``floor(1000 ln((2N + 2) / (2 df + 1)))``, norms ``50 + (50 n N) div L``; all else is in 64-bit integers.

Null and empty texts have no terms and are found by no query; a query without terms, or whose terms occur
nowhere, has no rows. Rows that repeat an item_id are one query with the terms of all; a null item_id is an
item of its own. Rows that repeat a doc_id are ranked each; at equal scores ids ascend, null ids last.
Queries are taken in blocks of bounded size; every block is one pass over all documents.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votesel.llm.common import arrow_schema, text_chunks
from votesel.session import materialize

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
BEST = 50
#: A block of queries: at most so many queries and (but for one longer query) terms. Bounds what a pass ships.
QUERIES_PER_PASS, TERMS_PER_PASS = 2_000, 200_000
#: A tree: at most so many documents and (but for one longer document) entries. Bounds a task's memory.
TREE_DOCS, TREE_ENTRIES = 30_000, 3_000_000
#: Documents met by the search are scored together in lots of this size.
LOT = 64


def terms_of(text: str | None) -> list[str]:
    return TERMS.findall(text.translate(LOWER)) if text else []


def saturated(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What terms of these weights add to a score."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def term_vectors(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document with a term: its length and its terms of the vocabulary."""
    schema = "doc_id long, n long, terms array<int>, tfs array<int>"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            ids, sizes, terms, tfs, ends = [], [], [], [], [0]
            for doc_id, text in zip(chunk["doc_id"], chunk["text"], strict=True):
                found = terms_of(text)
                if not found:
                    continue
                ids.append(doc_id)
                sizes.append(len(found))
                for word, tf in Counter(found).items():
                    t = vocabulary.get(word)
                    if t is not None:
                        terms.append(t)
                        tfs.append(tf)
                ends.append(len(terms))
            if ids:
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())).cast(arrow.field("terms").type) for v in (terms, tfs)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").mapInArrow(run, schema)


class DocumentTree:
    """FP-tree of a block of documents. Nodes are numbered in preorder, documents by their sorted vectors.

    ``label`` the node's term rank, ``tf`` and ``m`` the bounds, ``first`` and ``last`` the run of documents,
    ``end`` the number behind the node's subtree; ``headers[r]`` lists the nodes of term rank r."""

    def __init__(self, ids: list, m: np.ndarray, at: np.ndarray, ranks: np.ndarray, tfs: np.ndarray):
        """``ranks`` ascend within each document's slice ``at[i]:at[i + 1]``."""
        big = ranks.astype(">u4")
        keys = [big[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = np.diff(at)[order]
        self.at = np.r_[0, np.cumsum(size)]
        take = np.arange(self.at[-1]) + np.repeat(at[:-1][order] - self.at[:-1], size)
        self.ranks, self.tfs, self.m = ranks[take], tfs[take], m[order]
        self.ids = [ids[i] for i in order]
        node_of = np.empty(len(take), np.int64)
        shared = self._shared(size)
        made = size - shared
        start = np.r_[0, np.cumsum(made)]
        total = int(start[-1])
        self.first = np.repeat(np.arange(len(size)), made)
        self.last = np.full(total, len(size))
        path = np.empty(int(size.max(initial=0)) + 1, np.int64)
        deep = 0
        for i, (s, n) in enumerate(zip(shared.tolist(), size.tolist(), strict=True)):
            self.last[path[s:deep]] = i
            path[s:n] = np.arange(start[i], start[i + 1])
            node_of[self.at[i] : self.at[i] + n] = path[:n]
            deep = n
        self.end = start[self.last]
        self.label = np.empty(total, np.int64)
        self.label[node_of] = self.ranks
        self.tf = np.zeros(total, np.int64)
        np.maximum.at(self.tf, node_of, self.tfs)
        self.least = np.full(total, np.iinfo(np.int64).max)
        np.minimum.at(self.least, node_of, np.repeat(self.m, size))
        by_label = np.argsort(self.label, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(self.label[by_label]) > 0]) if total else np.empty(0, np.int64)
        self.headers = dict(zip(self.label[by_label[cuts]].tolist(), np.split(by_label, cuts[1:]), strict=True)) if total else {}

    def _shared(self, size: np.ndarray) -> np.ndarray:
        """Length of the prefix that each sorted vector shares with the one before."""
        shared = np.zeros(len(size), np.int64)
        both = np.minimum(size[1:], size[:-1])
        some = np.flatnonzero(both)
        if not len(some):
            return shared
        n = both[some]
        cut = np.r_[0, np.cumsum(n)[:-1]]
        inside = np.arange(int(n.sum())) - np.repeat(cut, n)
        here, there = np.repeat(self.at[some + 1], n) + inside, np.repeat(self.at[some], n) + inside
        differ = np.where(self.ranks[here] == self.ranks[there], np.repeat(n, n), inside)
        shared[some + 1] = np.minimum.reduceat(differ, cut)
        return shared

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of documents; ``weights`` by term rank, 0 for terms that the query has not."""
        size = self.at[docs + 1] - self.at[docs]
        cut = np.r_[0, np.cumsum(size)[:-1]]
        take = np.arange(int(size.sum())) + np.repeat(self.at[docs] - cut, size)
        w = weights[self.ranks[take]]
        of = np.repeat(np.arange(len(docs)), size)[w > 0]
        take, w = take[w > 0], w[w > 0]
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, of, saturated(w, self.tfs[take], self.m[docs[of]]))
        return out

    def search(self, ranks: list[int], weights: np.ndarray, best: "BestOf") -> None:
        """Offers to ``best`` every document that may be among its best."""
        lists = [self.headers[r] for r in ranks if r in self.headers]
        if not lists:
            return
        nodes = np.sort(np.concatenate(lists))
        bound = saturated(weights[self.label[nodes]], self.tf[nodes], self.least[nodes])
        behind = np.searchsorted(nodes, self.end[nodes])  # the next of these nodes outside the subtree
        step = np.zeros(len(nodes) + 1, np.int64)
        step[:-1] = bound
        np.subtract.at(step, behind, bound)
        way = np.cumsum(step)  # sum of the bounds on the way to each node; the last is 0
        pairs = np.column_stack([np.arange(len(nodes)), behind]).ravel()
        most = np.maximum.reduceat(way, pairs)[::2]  # the largest sum in each subtree
        first, last = self.first[nodes], self.last[nodes]
        met: list[tuple[int, int]] = []
        waiting = 0

        def children(i: int, stop: int) -> list[int]:
            out = []
            while i < stop:
                out.append(i)
                i = int(behind[i])
            return out

        # a stack of nodes, the most promising on top
        stack = sorted(children(0, len(nodes)), key=most.__getitem__)
        while stack:
            i = stack.pop()
            if not best.wants(int(most[i])):
                continue
            below = children(i + 1, int(behind[i]))
            if best.wants(int(way[i])):  # documents that have none of the query's further terms
                at = int(first[i])
                for c in below:
                    if at < first[c]:
                        met.append((at, int(first[c])))
                        waiting += int(first[c]) - at
                    at = int(last[c])
                if at < last[i]:
                    met.append((at, int(last[i])))
                    waiting += int(last[i]) - at
            stack.extend(sorted(below, key=most.__getitem__))
            if waiting >= LOT or (met and not stack):
                docs = np.concatenate([np.arange(a, b) for a, b in met])
                for score, d in zip(self.scores(docs, weights).tolist(), docs.tolist(), strict=True):
                    best.offer(score, self.ids[d])
                met, waiting = [], 0
        if met:
            docs = np.concatenate([np.arange(a, b) for a, b in met])
            for score, d in zip(self.scores(docs, weights).tolist(), docs.tolist(), strict=True):
                best.offer(score, self.ids[d])


class BestOf:
    """The ``k`` best documents so far: highest score, then smallest id (null last)."""

    def __init__(self, k: int = BEST):
        self.k, self.heap = k, []

    def wants(self, bound: int) -> bool:
        """Whether a document with this score might still enter (at equal scores by its id)."""
        return bound > 0 and (len(self.heap) < self.k or bound >= self.heap[0][0])

    def offer(self, score: int, doc_id: int | None) -> None:
        if score <= 0:
            return
        entry = (score, doc_id is not None, 0 if doc_id is None else -doc_id)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)

    def rows(self) -> Iterator[tuple[int | None, int]]:
        for score, known, negative in self.heap:
            yield (-negative if known else None), score


def query_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, set[str]]]]:
    """Queries ``(item_id, terms)`` in blocks that keep to the bounds of a pass."""
    block: list[tuple[int | None, set[str]]] = []
    held = 0
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), "text").groupBy("item_id").agg(F.array_sort(F.collect_set("text")).alias("texts")).orderBy("item_id")
    for row in texts.toLocalIterator():
        terms = {t for text in row.texts for t in terms_of(text)}
        if block and (len(block) == QUERIES_PER_PASS or held + len(terms) > TERMS_PER_PASS):
            yield block
            block, held = [], 0
        block.append((row.item_id, terms))
        held += len(terms)
    if block:
        yield block


def search_block(docs: DataFrame, queries: list[tuple[int | None, set[str]]], k: int = BEST) -> DataFrame:
    """``item_id, doc_id, score``: the best ``k`` of every task for each query of the block."""
    words = sorted(set().union(*[terms for _, terms in queries]))
    vocabulary = {w: t for t, w in enumerate(words)}
    vectors = materialize(term_vectors(docs, vocabulary))
    counted = vectors.agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
    N, L = counted.N, counted.L or 0
    df = np.zeros(len(words), np.int64)
    for row in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator():
        df[row.t] = row.df
    weight = np.array([math.floor(1000 * math.log((2 * N + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
    by_rank = np.lexsort((np.arange(len(words)), -df))
    rank_of = np.empty(len(words), np.int64)
    rank_of[by_rank] = np.arange(len(words))
    asked = [(item, sorted(int(rank_of[vocabulary[t]]) for t in terms if weight[vocabulary[t]] > 0)) for item, terms in queries]
    schema = "item_id long, doc_id long, score long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [BestOf(k) for _ in asked]
        ids: list = []
        parts: list[tuple[np.ndarray, ...]] = []

        def search() -> None:
            if not ids:
                return
            m = 50 + 50 * np.concatenate([p[0] for p in parts]) * N // L
            size = np.concatenate([p[1] for p in parts])
            ranks = rank_of[np.concatenate([p[2] for p in parts])]
            tfs = np.concatenate([p[3] for p in parts]).astype(np.int64)
            order = np.lexsort((ranks, np.repeat(np.arange(len(size)), size)))
            tree = DocumentTree(ids, m, np.r_[0, np.cumsum(size)], ranks[order], tfs[order])
            weights = np.zeros(len(words), np.int64)
            for (_, of_item), found in zip(asked, best, strict=True):
                if not of_item:
                    continue
                weights[of_item] = weight[by_rank[of_item]]
                tree.search(of_item, weights, found)
                weights[of_item] = 0

        held = 0
        for batch in batches:
            lists, tfs = batch.column(2), batch.column(3)
            size = np.diff(lists.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
            ids_in, n, terms, tf = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False)
            ends, done, at = np.cumsum(size), 0, 0
            while done < len(size):
                room = max(TREE_ENTRIES - held, 0)
                stop = min(max(int(np.searchsorted(ends, at + room, "right")), done if ids else done + 1), done + TREE_DOCS - len(ids), len(size))
                if stop > done:
                    upto = int(ends[stop - 1])
                    ids.extend(ids_in[done:stop])
                    parts.append((n[done:stop], size[done:stop], terms[at:upto], tf[at:upto]))
                    held += upto - at
                    done, at = stop, upto
                if done < len(size):
                    search()
                    ids, parts, held = [], [], 0
        search()
        rows = [(item, d, s) for (item, _), found in zip(asked, best, strict=True) for d, s in found.rows()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return vectors.where(F.size("terms") > 0).mapInArrow(run, schema)


def best_first() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("doc_id")]


def ranked_search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """``item_id, rank, doc_id, score``: each query's ``k`` documents of highest score above 0."""
    found = None
    for block in query_blocks(items):
        part = search_block(docs, block, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy(*best_first()))
    return found.withColumn("rank", nth).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
