"""Line dedup by pairwise alignment of documents that share rare lines.

A line alone may be common anywhere ("All rights reserved."); a run of consecutive lines with enough words
is rare, so the shared lines that pair documents are hashed as such runs: for every line the shortest run
that starts there, and the shortest that ends there, with ``least_words`` words or more (blank lines are
skipped). Each run has a first holder: the smallest doc_id, then position. A document is aligned with every
first holder of one of its runs: the runs both have are the anchors of a patience diff (the longest chain
that ascends in both), and the lines under the chain are deleted from the later document. Anchors off the
chain are blocks that moved; they are deleted as well when they hold ``moved_words`` words in a row.

So every document keeps what it holds first, each pair is a document and a first holder (never all
documents of a group), and no run is ignored however many documents hold it.

A block that crosses another one in its first holder may lie in order in another earlier document. With
``all_holders`` the runs that still stand are taken on: their holders (documents of equal text counted
once) are numbered by doc_id, and the document is aligned with them over all runs both share, 1, 2, 4, ...
holders a round, until no standing run has a holder left. The result is that of aligning every document
with every earlier one, but only what stands is paired.

Lines are compared after joining their words by one space. Null text and rows with null doc_id pass
unchanged; rows that repeat a doc_id never delete from each other; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votesel.llm.common import arrow_schema, text_chunks
from votesel.operators.ranking import checked_broadcast, exact_row_number, quantile_bucket
from votesel.session import materialize

LEAST_WORDS, MOVED_WORDS = 20, 50


def line_runs(text: str, least_words: int = LEAST_WORDS) -> list[tuple[int, int, int, int]]:
    """(hash, first line, last line, words) of every shortest run that starts or ends at a line."""
    lines = [(i, w) for i, raw in enumerate(text.split("\n")) if (w := raw.split())]
    if sum(len(w) for _, w in lines) < least_words:
        return []
    hashes = [xxhash.xxh64_digest(" ".join(w)) for _, w in lines]
    sizes = [len(w) for _, w in lines]
    found: dict[tuple[int, int], int] = {}
    n, stop, words = len(lines), 0, 0
    for start in range(n):  # runs that start at a line
        while stop < n and words < least_words:
            words += sizes[stop]
            stop += 1
        if words < least_words:
            break
        found[start, stop] = words
        words -= sizes[start]
    start, words = n, 0
    for stop in range(n, 0, -1):  # runs that end at a line
        while start > 0 and words < least_words:
            start -= 1
            words += sizes[start]
        if words < least_words:
            break
        found[start, stop] = words
        words -= sizes[stop - 1]
    return [(_signed(xxhash.xxh64_intdigest(b"".join(hashes[a:b]))), lines[a][0], lines[b - 1][0], w) for (a, b), w in sorted(found.items())]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def aligned_lines(anchors: list[tuple[int, int, int, int]], moved_words: int = MOVED_WORDS) -> set[int]:
    """Lines to delete, from anchors (first line here, last line here, first line there, words).

    The patience chain is the longest ascending chain of anchors; leftover anchors that follow each other
    in both documents form moved blocks."""
    anchors = sorted(set(anchors), key=lambda a: (a[0], -a[2], a[1]))
    tails: list[int] = []  # last partner line of the best chain of each length
    ends: list[int] = []
    back = [-1] * len(anchors)
    for k, (_, _, there, _) in enumerate(anchors):
        at = bisect_left(tails, there)
        back[k] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(there)
            ends.append(k)
        else:
            tails[at], ends[at] = there, k
    chain, k = set(), ends[-1] if ends else -1
    while k >= 0:
        chain.add(k)
        k = back[k]
    # runs that start and end at the same lines as the chain's differ only in which end fixed them
    shifts = {(anchors[k][0] - anchors[k][2]) for k in chain}
    gone = {i for k in chain for i in range(anchors[k][0], anchors[k][1] + 1)}
    rest = sorted((a[0] - a[2], a[0], a[1], a[3]) for k, a in enumerate(anchors) if k not in chain)
    at = 0
    while at < len(rest):
        shift, first, last, words = rest[at]
        stop = at + 1
        while stop < len(rest) and rest[stop][0] == shift and rest[stop][1] <= last + 1:
            if rest[stop][2] > last:
                words += rest[stop][3]
                last = rest[stop][2]
            stop += 1
        if shift in shifts or words >= moved_words:
            gone |= {*range(first, last + 1)}
        at = stop
    return gone


def align(pairs: DataFrame, keys: list[str], moved_words: int) -> DataFrame:
    """``doc_id, text_hash, lines`` of each pair (``keys`` and its ``anchors``)."""
    schema = "doc_id long, text_hash long, lines array<int>"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            lines = [sorted(aligned_lines([(a["first"], a["last"], a["there"], a["words"]) for a in found], moved_words)) for found in rows["anchors"]]
            yield pa.RecordBatch.from_pydict({"doc_id": rows["doc_id"], "text_hash": rows["text_hash"], "lines": lines}, schema=arrow)

    anchors = F.collect_list(F.struct("first", "last", "there", "words")).alias("anchors")
    return pairs.groupBy(*keys).agg(anchors).select("doc_id", "text_hash", "anchors").mapInArrow(run, schema)


def merged(aligned: DataFrame) -> DataFrame:
    """Distinct deleted lines per document, counted with the partners."""
    return aligned.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"), F.count("*").alias("n_partners"))


def still_standing(runs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``runs`` with a line that is not deleted. Each document's lines and runs meet in one row."""
    schema = "doc_id long, text_hash long, run long, first int, last int"
    arrow = arrow_schema(schema)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc_id, text_hash, lines, own in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text_hash", "lines", "own"))):
                deleted = set(lines or ())
                found += [(doc_id, text_hash, r["run"], r["first"], r["last"]) for r in own if not deleted.issuperset(range(r["first"], r["last"] + 1))]
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, f)) for f in found], schema=arrow)

    own = runs.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("run", "first", "last")).alias("own"))
    return own.join(gone.select("doc_id", "text_hash", "lines"), ["doc_id", "text_hash"], "left").mapInArrow(keep, schema)


def later_holders(runs: DataFrame, shared: DataFrame, gone: DataFrame, moved_words: int) -> DataFrame:
    """``gone`` (``doc_id, text_hash, lines, n_partners``) with the lines that holders beyond the first delete."""
    text = ["doc_id", "text_hash"]
    standing = materialize(still_standing(shared.select(*text, "run", "first", "last"), gone))
    if standing.isEmpty():
        return gone
    holders = runs.join(standing.select("run").distinct(), "run", "left_semi").groupBy("run", "text_hash").agg(F.min("doc_id").alias("holder"))
    holders = materialize(holders.withColumnRenamed("text_hash", "holder_hash"))
    largest = holders.groupBy("run").count().agg(F.max("count")).first()[0]
    bucketed, bucket = quantile_bucket(holders, ["run"], "holder", largest)
    ranked = exact_row_number(bucketed, ["run"], [F.col("holder"), F.col("holder_hash")], bucket, out="rank")
    ranked = materialize(ranked.select("run", "rank", "holder", "holder_hash"))
    places = runs.groupBy("doc_id", "text_hash", "run").agg(F.min("first").alias("there"))
    places = places.select(F.col("doc_id").alias("holder"), F.col("text_hash").alias("holder_hash"), "run", "there")
    lo = 1
    while True:
        asked = standing.select(*text, "run").distinct().withColumn("rank", F.explode(F.sequence(F.lit(lo), F.lit(2 * lo - 1))))
        pairs = materialize(asked.join(ranked, ["run", "rank"]).where("holder < doc_id").select(*text, "holder", "holder_hash").distinct())
        if pairs.isEmpty():  # ranks ascend by holder, so higher ranks hold no earlier document either
            return gone
        side = checked_broadcast(pairs)
        anchors = runs.join(side, text).join(places.join(checked_broadcast(pairs.select("holder", "holder_hash").distinct()), ["holder", "holder_hash"], "left_semi"), ["holder", "holder_hash", "run"])
        found = align(anchors, [*text, "holder", "holder_hash"], moved_words)
        gone = materialize(
            gone.unionByName(merged(found)).groupBy(*text).agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"), F.sum("n_partners").alias("n_partners"))
        )
        standing = materialize(still_standing(standing, gone))
        lo *= 2


def deletions(docs: DataFrame, least_words: int = LEAST_WORDS, moved_words: int = MOVED_WORDS, all_holders: bool = False) -> DataFrame:
    """``doc_id, text_hash, gone, n_partners``: per later document a flag for each line up to the last deleted."""
    schema = "doc_id long, text_hash long, run long, first int, last int, words int"
    arrow = arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            rows = [
                (doc_id, text_hash, *run)
                for doc_id, text_hash, text in zip(chunk["doc_id"], chunk["text_hash"], chunk["text"], strict=True)
                for run in line_runs(text, least_words)
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    named = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    runs = materialize(named.mapInArrow(cut, schema))
    # one row per run and holder table: partial sums first, so a run that everybody holds stays small
    holders = runs.groupBy("run").agg(F.min(F.struct("doc_id", "first")).alias("holder"), F.max("doc_id").alias("latest"))
    holders = holders.where("latest > holder.doc_id").select("run", F.col("holder.doc_id").alias("earlier"), F.col("holder.first").alias("there"))
    shared = runs.join(holders, "run").where("doc_id > earlier")

    grouped = merged(align(shared, ["doc_id", "text_hash", "earlier"], moved_words))
    if all_holders:
        grouped = later_holders(runs, materialize(shared), materialize(grouped), moved_words)
    out = "doc_id long, text_hash long, gone array<boolean>, n_partners long"

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            gone = []
            for lines in rows["lines"]:
                mark = [False] * (max(lines) + 1)
                for i in lines:
                    mark[i] = True
                gone.append(mark)
            yield pa.RecordBatch.from_pydict({"doc_id": rows["doc_id"], "text_hash": rows["text_hash"], "gone": gone, "n_partners": rows["n_partners"]}, schema=arrow_schema(out))

    return grouped.where(F.size("lines") > 0).mapInArrow(flags, out)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it differ from every column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, moved_words: int = MOVED_WORDS, all_holders: bool = False) -> DataFrame:
    """The rows of ``docs`` with the deleted lines taken out of ``text``, and ``_lines``, ``_removed``,
    ``_partners`` (long) with the counts; where ``docs`` has a column of such a name, the count's name gets
    further underscores in front."""
    found = materialize(deletions(docs, least_words, moved_words, all_holders))
    # the input in one column, so that its names meet no others
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64("row.text").alias("text_hash"))
    # always a shuffle by document: the deletions grow with the corpus, so their side is never broadcast
    out = rows.join(found.hint("merge"), ["doc_id", "text_hash"], "left")
    text, changed = F.col("row.text"), F.col("gone").isNotNull()
    lines = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.coalesce(F.get("gone", i), F.lit(False))), "\n")
    own = [(F.when(changed, kept).otherwise(text) if c.lower() == "text" else F.col("row")[c]).alias(c) for c in docs.columns]
    return out.select(
        *own,
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias(free_name(docs, "_lines")),
        F.when(changed, F.size(F.filter("gone", lambda x: x))).otherwise(0).cast("long").alias(free_name(docs, "_removed")),
        F.coalesce("n_partners", F.lit(0)).cast("long").alias(free_name(docs, "_partners")),
    )


def line_report(docs: DataFrame, all_holders: bool = False) -> DataFrame:
    """``doc_id, n_lines, n_removed, n_partners, kept_sha256`` per row (digest of the text that is left)."""
    out = dedup_lines(docs.select("doc_id", "text"), all_holders=all_holders)
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.col("_partners").alias("n_partners"), digest.alias("kept_sha256"))
