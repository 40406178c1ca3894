"""Near-duplicate documents by DartMinHash signatures and banded joining.

A text is the multiset of its five-word shingles; a shingle that occurs c times has weight c, a region of
c unit cells. Every cell is a target on which darts land in the order of a hashed Poisson process: the
gaps between a cell's darts are exponential in a hash of (cell, dart number), and another hash deals each
dart to one of K coordinates. Each coordinate keeps the earliest dart; two texts agree on a coordinate with
the probability of their weighted Jaccard similarity. Darts are thrown up to a time that fills all
coordinates in expectation, so a text costs one hash per cell plus about K ln K darts; texts with an empty
coordinate throw on to twice that time.

Signatures are cut into bands; texts that agree on a whole band are candidates. Exact copies are one class
from the start. In each band bucket the text with the most candidates is the hub of a star of pairs (the
original of a group of near copies shares more bands with them than they do with each other). The pairs of the
stars are verified by exact weighted Jaccard. Texts whose bucket then still holds another class meet by an
exact prefix filter over their rarest cells, so every two texts of a bucket end in one class, are compared, or
are proved unlike; unlike texts of a crowded bucket do not cost their pairs. Components of the verified links
are the classes.

Most unlike pairs are told from two sketches, without their texts: a sketch holds the parities of the cells'
counts in 1024 hash classes. Two sketches differ in no more places than the texts differ in cells, which
bounds the similarity from above; only pairs whose bound reaches the threshold are compared cell by cell.

Words are runs of word characters in lower case. A text with one to four words is one shingle. Texts
without a word and rows with null doc_id are no one's copies. Rows that repeat a doc_id count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votesel.llm.common import arrow_schema, mix, text_chunks, token_codes
from votesel.session import materialize

#: 20 bands of 6 coordinates: a pair at similarity 0.8 shares a band with probability 0.998, at 0.5 with 0.27.
SHINGLE, COORDINATES, ROWS, SIMILARITY = 5, 120, 6, 0.8
#: 64-bit words of a sketch.
SKETCH_WORDS = 16


def cells_of(codes: np.ndarray) -> np.ndarray:
    """Sorted 64-bit cells of a text: one per occurrence of a shingle, numbered within equal shingles."""
    n = len(codes)
    if n == 0:
        return np.empty(0, np.uint64)
    size = min(SHINGLE, n)
    h = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        h = mix(h ^ codes[k : k + len(h)])
    h.sort()
    first = np.r_[True, h[1:] != h[:-1]]
    if first.all():
        return h
    at = np.arange(len(h))
    nth = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return np.sort(np.where(nth > 0, mix(h + nth * np.uint64(0xD1342543DE82EF95)), h))


def dart_signatures(texts: list[np.ndarray], k: int = COORDINATES) -> np.ndarray:
    """Signature matrix (text, coordinate) of dart ids; texts must have cells."""
    sizes = np.array([len(c) for c in texts], np.int64)
    sig = np.zeros((len(texts), k), np.uint64)
    todo = np.arange(len(texts))
    until = k * (math.log(k) + 2.0) / sizes
    while len(todo):
        cells = np.concatenate([texts[i] for i in todo])
        owner = np.repeat(np.arange(len(todo)), sizes[todo])
        end = until[todo][owner]
        time = np.zeros(len(cells))
        keys, times, ids = [], [], []
        nth = 0
        while len(cells):
            nth += 1
            dart = mix(cells ^ np.uint64(nth * 0x9E3779B97F4A7C15 % 2**64))
            time = time - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            live = time <= end
            cells, owner, end, time, dart = cells[live], owner[live], end[live], time[live], dart[live]
            keys.append(owner * k + (mix(dart) % np.uint64(k)).astype(np.int64))
            times.append(time)
            ids.append(dart)
        key, at, dart = np.concatenate(keys), np.concatenate(times), np.concatenate(ids)
        earliest = np.full(len(todo) * k, np.inf)
        np.minimum.at(earliest, key, at)
        won = at == earliest[key]
        flat = np.zeros(len(todo) * k, np.uint64)
        flat[key[won]] = dart[won]
        sig[todo] = flat.reshape(len(todo), k)
        todo = todo[np.isinf(earliest).reshape(len(todo), k).any(axis=1)]
        until[todo] *= 2
    return sig


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per text and band."""
    n, k = sig.shape
    parts = sig.reshape(n, k // rows, rows)
    h = np.broadcast_to(np.arange(k // rows, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        h = mix(h ^ parts[:, :, r])
    return h.view(np.int64)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted cell arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def text_key(codes: np.ndarray) -> tuple[int, int]:
    """128-bit key of a word sequence."""
    import xxhash

    h = xxhash.xxh128_intdigest(codes.tobytes())
    return int(np.uint64(h >> 64).astype(np.int64)), int(np.uint64(h & (2**64 - 1)).astype(np.int64))


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, k1, k2, bands`` of every text with a word."""
    schema = "doc_id long, k1 long, k2 long, bands array<long>"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            coded = [(d, c) for d, t in zip(chunk["doc_id"], chunk["text"], strict=True) if len(c := token_codes(t))]
            if not coded:
                continue
            bands = band_keys(dart_signatures([cells_of(c) for _, c in coded]))
            keys = [text_key(c) for _, c in coded]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(coded) + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in coded], pa.int64()), pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()), flat.cast(arrow.field("bands").type)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, schema)


def sketch_of(cells: np.ndarray) -> np.ndarray:
    """Parity of the number of cells in each of the hash classes, as 64-bit words."""
    classes = 64 * SKETCH_WORDS
    odd = np.bincount((mix(cells) % np.uint64(classes)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def cell_table(docs: DataFrame) -> DataFrame:
    """``doc_id, cells, size, sketch``: the sorted cells of each text, their number and their sketch."""
    schema = "doc_id long, cells binary, size long, sketch array<long>"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            cells = [cells_of(token_codes(t)) for t in chunk["text"]]
            sketches = pa.array([sketch_of(c) for c in cells], pa.list_(pa.int64())).cast(arrow.field("sketch").type)
            yield pa.RecordBatch.from_arrays([pa.array(chunk["doc_id"], pa.int64()), pa.array([c.tobytes() for c in cells], pa.binary()), pa.array([len(c) for c in cells], pa.int64()), sketches], schema=arrow)

    return docs.mapInArrow(run, schema)


def possible(pairs: DataFrame, cells: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs ``(a, b)`` without those that sizes and sketches prove to be less similar than the threshold.

    With d cells that only one of two texts has, the similarity is (size - d) / (size + d) for their summed
    size; d is at least the difference of the sizes and the number of places where the sketches differ."""
    left = cells.select(F.col("doc_id").alias("a"), F.col("size").alias("na"), F.col("sketch").alias("sa"))
    right = cells.select(F.col("doc_id").alias("b"), F.col("size").alias("nb"), F.col("sketch").alias("sb"))
    odd = sum((F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k])) for k in range(SKETCH_WORDS)), F.lit(0))
    bound = F.greatest(odd.cast("long"), F.abs(F.col("na") - F.col("nb"))) * (1 + similarity) <= (F.col("na") + F.col("nb")) * (1 - similarity) + 1e-6
    return pairs.join(right, "b").join(left, "a").where(bound).select("a", "b")


def verified(pairs: DataFrame, cells: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs ``(a, b)`` whose weighted Jaccard similarity reaches the threshold."""
    schema = "a long, b long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [
                (a.as_py(), b.as_py())
                for a, b, ca, cb in zip(*batch.columns, strict=True)
                if weighted_jaccard(np.frombuffer(ca.as_buffer(), np.uint64), np.frombuffer(cb.as_buffer(), np.uint64)) >= similarity
            ]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept)], schema=arrow)

    left = cells.select(F.col("doc_id").alias("a"), F.col("cells").alias("ca"))
    right = cells.select(F.col("doc_id").alias("b"), F.col("cells").alias("cb"))
    return possible(pairs, cells, similarity).join(right, "b").join(left, "a").select("a", "b", "ca", "cb").mapInArrow(run, schema)


def star_links(entries: DataFrame, cells: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Verified links ``(a, b)``, a < b, of bucket entries ``(band, doc_id, weight)``, and their components.

    The text of highest weight in a bucket is paired with its members. Texts that after this share a bucket
    with another component go through ``prefix_pairs``, which misses no pair of them at the threshold."""
    entries = materialize(entries.withColumn("own", F.col("doc_id")))
    leader = F.row_number().over(Window.partitionBy("band").orderBy(F.desc("weight"), "doc_id"))
    hubs = entries.withColumn("nth", leader).where("nth = 1").select("band", F.col("doc_id").alias("hub"))
    star = entries.join(hubs, "band").where("doc_id <> hub")
    pairs = star.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()
    found = materialize(verified(pairs, cells, similarity))
    labels = components(found)
    own = F.coalesce("label", "doc_id").alias("own")
    entries = materialize(entries.drop("own").join(labels, "doc_id", "left").select("band", "doc_id", own))
    rest = entries.join(_mixed(entries), "band", "left_semi").select("doc_id", "own").distinct()
    links = materialize(verified(prefix_pairs(rest, cells, similarity), cells, similarity))
    if links.isEmpty():
        return found, labels
    # the new links are between components: only those that they touch get new labels
    of = materialize(rest)
    ends = links.join(of.select(F.col("doc_id").alias("a"), F.col("own").alias("x")), "a").join(of.select(F.col("doc_id").alias("b"), F.col("own").alias("y")), "b")
    merged = components(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    known = labels.unionByName(merged.select("doc_id", F.col("doc_id").alias("label"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    labels = known.join(merged.select(F.col("doc_id").alias("label"), F.col("label").alias("further")), "label", "left").select("doc_id", F.coalesce("further", "label").alias("label"))
    return materialize(found.unionByName(links).distinct()), materialize(labels)


def _mixed(entries: DataFrame) -> DataFrame:
    """Buckets with members of different components."""
    return entries.groupBy("band").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select("band")


def prefix_pairs(texts: DataFrame, cells: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs ``(a, b)`` of the texts ``(doc_id, own)``, different in ``own``, that may reach the threshold.

    With every text's cells in one order, the rarest first, two similar texts share a cell among the first
    ``n - ceil(s n) + 1`` of the longer and the first ``n - ceil(2 s n / (1 + s)) + 1`` of the shorter one, and
    what is left behind their first common cell must still hold the overlap that the threshold asks. Texts that
    are alike in a common frame only differ in their first cells and never meet. In a cell's group the texts of
    its most frequent component are not paired with each other."""
    schema = "doc_id long, cell long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, held in zip(*batch.columns, strict=True):
                h = np.frombuffer(held.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), doc_id.as_py())), pa.array(h)], schema=arrow)

    texts = materialize(texts.join(cells.select("doc_id", "cells", "size"), "doc_id"))
    single = materialize(texts.select("doc_id", "cells").mapInArrow(run, schema))
    common = single.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    # cells of one text alone come first and are only counted
    order = Window.partitionBy("doc_id").orderBy("n", "cell")
    shared = single.join(common, "cell").withColumn("nth", F.row_number().over(order)).withColumn("n_shared", F.count("*").over(Window.partitionBy("doc_id")))
    placed = shared.join(texts.drop("cells"), "doc_id").withColumn("place", F.col("size") - F.col("n_shared") + F.col("nth") - 1)

    def upto(share: float) -> Column:
        return F.col("place") <= F.col("size") - F.ceil(share * F.col("size") - 1e-6)

    kept = materialize(placed.where(upto(similarity)).select("cell", "doc_id", "own", "size", "place", upto(2 * similarity / (1 + similarity)).alias("early")))
    groups = kept.groupBy("cell", "own").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max_by("own", F.struct("n", "own")).alias("main"), F.count("*").alias("n_own")).where("n_own > 1")
    meeting = kept.join(groups.select("cell", "main"), "cell")
    x = meeting.where("own <> main").select("cell", *[F.col(c).alias(f"x_{c}") for c in ("doc_id", "own", "size", "place", "early")])
    y = meeting.select("cell", *[F.col(c).alias(f"y_{c}") for c in ("doc_id", "own", "size", "place", "early")])
    shorter = F.expr("x_size < y_size OR x_size = y_size AND x_doc_id < y_doc_id")
    fits = F.when(shorter, F.col("x_early")).otherwise(F.col("y_early")) & (F.least("x_size", "y_size") >= similarity * F.greatest("x_size", "y_size") - 1e-6)
    behind = F.least(F.col("x_size") - F.col("x_place"), F.col("y_size") - F.col("y_place"))
    enough = behind >= similarity / (1 + similarity) * (F.col("x_size") + F.col("y_size")) - 1e-6
    return x.join(y, "cell").where((F.col("x_own") != F.col("y_own")) & fits & enough).select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``doc_id, label``: the smallest doc_id of each linked document's component.

    Every round takes the smallest label among neighbours, then the label's own label, written as a table;
    ends when no label falls."""
    both = materialize(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    labels = materialize(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), F.col("label").alias("other")), "y").groupBy("x").agg(F.min("other").alias("other"))
        step = labels.join(near, "x").select("x", F.least("label", "other").alias("label"), F.col("label").alias("was"))
        jump = step.select(F.col("x").alias("label"), F.col("label").alias("further"))
        step = materialize(step.join(jump, "label", "left").select("x", F.least("label", F.coalesce("further", "label")).alias("label"), "was"))
        labels = step.select("x", "label")
        if step.where("label < was").isEmpty():
            return labels.select(F.col("x").alias("doc_id"), "label")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, text_id, class_id, n_links, kept`` per row of ``docs``.

    ``text_id`` is the smallest doc_id with the same words, ``class_id`` the smallest of the near-duplicate
    class, ``n_links`` the verified links of this text to other texts found by the stars, ``kept`` whether
    the row's id is the class's."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(signatures(rows))
    texts = materialize(signed.groupBy("k1", "k2").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("text_id")))
    entries = texts.select(F.explode("bands").alias("band"), F.col("text_id").alias("doc_id"))
    crowded = entries.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    entries = materialize(entries.join(crowded, "band"))
    members = materialize(entries.groupBy("doc_id").agg(F.sum("n").alias("weight")))
    entries = entries.select("band", "doc_id").join(members, "doc_id")
    known = rows.where("text IS NOT NULL").join(members.select("doc_id").hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    links, labels = star_links(entries, materialize(cell_table(known)), similarity)
    degree = links.select(F.col("a").alias("text_id")).unionByName(links.select(F.col("b").alias("text_id"))).groupBy("text_id").agg(F.count("*").alias("n_links"))
    classes = texts.select("k1", "k2", "text_id").join(labels.select(F.col("doc_id").alias("text_id"), "label"), "text_id", "left").join(degree, "text_id", "left")
    of = signed.select("doc_id", "k1", "k2").join(classes, ["k1", "k2"]).select("doc_id", "text_id", F.coalesce("label", "text_id").alias("class_id"), "n_links").dropDuplicates(["doc_id"])
    out = rows.select("doc_id").join(of, "doc_id", "left")
    class_id = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", F.coalesce("text_id", "doc_id").alias("text_id"), class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))
