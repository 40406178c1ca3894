"""Removal of long repeated byte strings by prefix-free parsing.

A byte is removed when it lies under a string of ``WIDTH`` bytes that also starts in a document with a
smaller doc_id. Every such string is a suffix of the corpus cut at ``WIDTH``; the parsing groups them:

* Triggers: a rolling hash is taken of every ``GRAM`` bytes; the least of the hashes inside a string of
  ``WIDTH`` bytes is its trigger. Strings that start one after the other mostly have the same trigger, so a
  text falls into phrases: maximal runs of starts with one trigger, together with all bytes of their
  strings. Phrase borders follow from the content alone, and equal strings sit at the same place relative
  to equal triggers, whatever surrounds them.
* Dictionary: phrases are shipped as (trigger, phrase hash) with their first holder. A phrase whose hash has
  a holder in a smaller document is removed as a whole; a batch of documents ships only its own first
  holders, so a phrase that a third of all documents hold stays small on the way.
* Corpus order: where a trigger has several different phrases, the phrases' suffixes are put in order (the
  suffix array of that part of the dictionary, cut at ``WIDTH``); equal neighbours are equal strings, and
  each takes its first holder. Only first holders of different phrases take part.

Texts are UTF-8 bytes; matches never cross documents. Null text counts as empty; rows with null doc_id
match nothing; rows that repeat a doc_id never remove from each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votesel.llm.common import arrow_schema, mix, text_chunks
from votesel.session import materialize

WIDTH, GRAM = 50, 20
#: Bytes of text per bucket of phrases; a bucket is one task's part of the dictionary.
BUCKET_BYTES = 4_000_000

#: ``text`` tells rows that repeat a doc_id apart.
PHRASE = np.dtype([("trigger", "<u8"), ("phrase", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("start", "<u4"), ("n", "<u2")])
#: Bytes of each field on the way: 48 bits of the trigger and 40 of the phrase name a phrase together.
SENT = (("trigger", 6), ("phrase", 5), ("doc", 8), ("text", 8), ("start", 4), ("n", 1))


def pack(rows: np.ndarray) -> bytes:
    """Rows by document and start, field by field in byte planes (ids as differences), compressed."""
    planes = [np.array([len(rows)], "<u8").tobytes()]
    for name, size in SENT:
        values = rows[name].astype(np.int64).view(np.uint64)
        if name in ("doc", "text"):
            values = np.diff(values, prepend=np.uint64(0))
        planes.append(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blobs) -> np.ndarray:
    parts = []
    reader = zstandard.ZstdDecompressor()
    for blob in blobs:
        raw = reader.decompress(blob)
        n = int(np.frombuffer(raw, "<u8", 1)[0])
        rows, at = np.empty(n, PHRASE), 8
        for name, size in SENT:
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
            values = wide.reshape(-1).view("<u8")
            if name in ("doc", "text"):
                values = np.cumsum(values, dtype=np.uint64)
            rows[name] = values.astype(np.uint64).view(np.int64) if name in ("doc", "text") else values
            at += n * size
        parts.append(rows)
    return np.concatenate(parts) if parts else np.empty(0, PHRASE)


def string_hashes(data: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes: polynomial hashes put together from halves by doubling."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, step, h = base, 1, mix(data.astype(np.uint64) + np.uint64(1))
    out, done = None, 0
    rest = size
    while True:
        if rest & 1:
            if out is None:
                out = h.copy()
            else:
                m = len(data) - done - step + 1
                out = out[:m] * np.uint64(power) + h[done : done + m]
            done += step
        rest >>= 1
        if not rest:
            return mix(out[:n])
        h = h[:-step] * np.uint64(power) + h[step:]
        power = power * power % 2**64
        step *= 2


def phrases_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigger hash, phrase hash, first start, number of starts) of a text's phrases."""
    n = len(data) - WIDTH + 1
    if n <= 0:
        z = np.empty(0, np.uint64)
        return z, z, np.empty(0, np.int64), np.empty(0, np.int64)
    grams = string_hashes(data, GRAM, 0xD6E8FEB86659FD93)
    span = WIDTH - GRAM + 1
    # least gram hash under each string (its low bits give way to the distance: ties go to the last gram)
    at = np.arange(len(grams))
    least, size = (grams >> np.uint64(20) << np.uint64(20)) | (np.uint64(0xFFFFF) - (at & 0xFFFFF).astype(np.uint64)), 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:n], least[span - size : span - size + n])
    edge = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    count = np.diff(np.r_[edge, n])
    position = edge + _first_gram(least[edge], edge, span)
    strings = string_hashes(data, WIDTH, 0xA0761D6478BD642F)
    # a phrase's strings overlap from first to last, so its first and last strings and their number name it
    last = edge + count - 1
    named = mix(mix(strings[edge]) ^ strings[last] ^ (count.astype(np.uint64) << np.uint64(48)))
    middle = mix(strings[edge + count // 2])
    return grams[position] >> np.uint64(16), mix(named ^ middle) >> np.uint64(24), edge, count


def _first_gram(least: np.ndarray, edge: np.ndarray, span: int) -> np.ndarray:
    """Offset of the trigger inside the string, from the position bits in its least value."""
    position = np.int64(0xFFFFF) - (least & np.uint64(0xFFFFF)).astype(np.int64)
    return (position - edge) & 0xFFFFF


def _first_holders(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in (trigger, phrase, doc) order, and for each the smallest doc of its phrase."""
    rows = rows[np.lexsort((rows["doc"], rows["phrase"], rows["trigger"]))]
    new = np.r_[True, (rows["trigger"][1:] != rows["trigger"][:-1]) | (rows["phrase"][1:] != rows["phrase"][:-1])]
    return rows, rows["doc"][np.flatnonzero(new)[np.cumsum(new) - 1]]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Joined byte ranges under strings, as pairs (begin, end) of unsigned 32-bit integers."""
    order = np.argsort(starts, kind="stable")
    begin, end = starts[order].astype(np.int64), starts[order].astype(np.int64) + counts[order].astype(np.int64) - 1 + WIDTH
    top = np.maximum.accumulate(end)
    new = np.r_[True, begin[1:] > top[:-1]]
    first = np.flatnonzero(new)
    return np.stack([begin[first], top[np.r_[first[1:] - 1, len(begin) - 1]]], axis=1).astype("<u4")


def _by_text(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in (doc, text, start) order, and the place of each text's first row (the end as well)."""
    if len(rows) == 0:
        return rows, np.zeros(1, np.int64)
    rows = rows[np.lexsort((rows["start"], rows["text"], rows["doc"]))]
    new = (rows["doc"][1:] != rows["doc"][:-1]) | (rows["text"][1:] != rows["text"][:-1])
    return rows, np.flatnonzero(np.r_[True, new, True])


def _binaries(raw: bytes, cuts: np.ndarray) -> pa.Array:
    """Arrow array of the byte strings between the cuts."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(raw)])


SHIPPED = "bucket int, kind int, doc_id long, text_hash long, data binary"
FOUND = "doc_id long, text_hash long, kind int, data binary"
#: A phrase that its document is asked for.
ASKED = np.dtype([("trigger", "<u8"), ("start", "<u4"), ("n", "<u2")])


def _found(kind: int, rows: np.ndarray, cuts: np.ndarray, data: pa.Array) -> pa.Table:
    """One row per text of ``rows`` (in order, cut by text)."""
    first = rows[cuts[:-1]]
    columns = [pa.array(first["doc"].copy()), pa.array(first["text"].copy()), pa.array(np.full(len(first), kind, np.int32)), data]
    return pa.Table.from_arrays(columns, schema=arrow_schema(FOUND))


def _found_ranges(rows: np.ndarray) -> pa.Table:
    """Joined byte ranges under the rows' strings, per text (kind 1)."""
    rows, cuts = _by_text(rows)
    if len(rows) == 0:
        return _found(1, rows, cuts, _binaries(b"", cuts))
    # texts are lifted apart, so one running maximum joins the ranges of all of them
    lift = np.repeat(np.arange(len(cuts) - 1, dtype=np.int64) << 33, np.diff(cuts))
    begin = rows["start"].astype(np.int64) + lift
    end = begin + rows["n"].astype(np.int64) - 1 + WIDTH
    top = np.maximum.accumulate(end)
    first = np.flatnonzero(np.r_[True, begin[1:] > top[:-1]])
    pairs = np.stack([begin[first], top[np.r_[first[1:] - 1, len(begin) - 1]]], axis=1) - lift[first][:, None]
    return _found(1, rows, cuts, _binaries(pairs.astype("<u4").tobytes(), np.searchsorted(first, cuts) * 8))


def _parse(n_buckets: int):
    """Map side: phrases of each chunk of documents, split by trigger into buckets."""
    arrow = arrow_schema(SHIPPED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, chars=4_000_000):
            parts = []
            for doc_id, text_hash, text in zip(chunk["doc_id"], chunk["text_hash"], chunk["text"], strict=True):
                trigger, phrase, start, n = phrases_of(np.frombuffer(text.encode(), np.uint8))
                rows = np.empty(len(start), PHRASE)
                rows["trigger"], rows["phrase"], rows["doc"], rows["text"], rows["start"], rows["n"] = trigger, phrase, doc_id, text_hash, start, n
                parts.append(rows)
            rows, first = _first_holders(np.concatenate(parts))
            own = rows["doc"] == first
            later = _found_ranges(rows[~own])
            if later.num_rows:
                bucket = (later["doc_id"].to_numpy() % n_buckets).astype(np.int32)
                yield from later.add_column(0, "bucket", pa.array(bucket)).select(arrow.names).to_batches()
            rows = rows[own]
            bucket = (rows["trigger"] % np.uint64(n_buckets)).astype(np.int64)
            order = np.lexsort((rows["start"], rows["text"], rows["doc"], bucket))
            rows, bucket = rows[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(rows) else []
            out = [(int(bucket[a]), 0, 0, 0, pack(rows[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    return run


def _dictionary(group: pa.Table) -> pa.Table:
    """Reduce side of a bucket: whole phrases with an earlier holder (kind 1), and the phrases whose
    suffixes must be put in order because their trigger has several phrases in several documents (kind 2)."""
    out = [group.filter(pc.equal(group["kind"], 1)).select(["doc_id", "text_hash", "kind", "data"])]
    rows = unpack(group.filter(pc.equal(group["kind"], 0))["data"].to_pylist())
    if len(rows):
        rows, first = _first_holders(rows)
        whole = rows["doc"] > first
        out.append(_found_ranges(rows[whole]))
        rest = rows[~whole]
        edge = np.r_[True, rest["trigger"][1:] != rest["trigger"][:-1]]
        begins = np.flatnonzero(edge)
        lowest, highest = np.minimum.reduceat(rest["doc"], begins), np.maximum.reduceat(rest["doc"], begins)
        open_rows, cuts = _by_text(rest[(lowest < highest)[np.cumsum(edge) - 1]])
        asked = np.empty(len(open_rows), ASKED)
        for name in ASKED.names:
            asked[name] = open_rows[name]
        out.append(_found(2, open_rows, cuts, _binaries(asked.tobytes(), cuts * ASKED.itemsize)))
    return pa.concat_tables([t.cast(arrow_schema(FOUND)) for t in out])


CUT = "bucket int, phrases binary, cut binary"


def _cut_phrases(n_buckets: int):
    """Bytes of the open phrases, from the documents that hold them, split by trigger into buckets."""
    arrow = arrow_schema(CUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            parts, cuts = [], []
            for doc_id, text_hash, text, found in zip(chunk["doc_id"], chunk["text_hash"], chunk["text"], chunk["asked"], strict=True):
                asked, data = np.frombuffer(b"".join(found), ASKED), text.encode()
                rows = np.zeros(len(asked), PHRASE)
                for name in ASKED.names:
                    rows[name] = asked[name]
                rows["doc"], rows["text"] = doc_id, text_hash
                parts.append(rows)
                cuts += [data[s : s + n - 1 + WIDTH] for s, n in zip(asked["start"].tolist(), asked["n"].tolist())]
            rows = np.concatenate(parts)
            bucket = (rows["trigger"] % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1], True])
            out = [(int(bucket[order[a]]), rows[order[a:b]].tobytes(), b"".join([cuts[i] for i in order[a:b].tolist()])) for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    return run


def _order_suffixes(group: pa.Table) -> pa.Table:
    """Strings of a bucket's open phrases in corpus order; those with an earlier holder, as ranges."""
    rows = np.frombuffer(b"".join(group["phrases"].to_pylist()), PHRASE)
    data = np.frombuffer(b"".join(group["cut"].to_pylist()), np.uint8)
    sizes = rows["n"].astype(np.int64) - 1 + WIDTH
    begin = np.cumsum(sizes) - sizes
    n = rows["n"].astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), n)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[owner] + inside
    # suffixes cut at WIDTH: a view of fixed-width keys, ordered bytewise
    windows = np.lib.stride_tricks.sliding_window_view(data, WIDTH)
    found = []
    shards = len(at) // 200_000 + 1
    for shard in range(shards):  # bounds the memory for the keys; strings with one trigger stay together
        pick = np.flatnonzero((mix(rows["trigger"])[owner] % np.uint64(shards)).astype(np.int64) == shard)
        if len(pick) == 0:
            continue
        keys = np.ascontiguousarray(windows[at[pick]]).view(np.dtype((np.void, WIDTH))).ravel()
        _, same = np.unique(keys, return_inverse=True)
        doc = rows["doc"][owner[pick]]
        lowest = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, same, doc)
        found.append(pick[lowest[same] < doc])
    hit = np.concatenate(found) if found else np.empty(0, np.int64)
    marks = rows[owner[hit]]
    marks["start"] = marks["start"] + inside[hit]
    marks["n"] = 1
    return _found_ranges(marks)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, data``: byte ranges to remove (unsigned 32-bit pairs), several rows per text."""
    named = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(8, size // BUCKET_BYTES)
    shipped = named.mapInArrow(_parse(n_buckets), SHIPPED)
    found = materialize(shipped.groupBy("bucket").applyInArrow(_dictionary, FOUND))
    asked = found.where("kind = 2").groupBy("doc_id", "text_hash").agg(F.collect_list("data").alias("asked"))
    cut = named.join(asked.hint("merge"), ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "asked").mapInArrow(_cut_phrases(n_buckets), CUT)
    more = cut.groupBy("bucket").applyInArrow(_order_suffixes, FOUND)
    return found.where("kind = 1").unionByName(more).select("doc_id", "text_hash", "data")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row of ``docs``."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    arrow = arrow_schema(schema)
    ranges = materialize(repeated_ranges(docs).groupBy("doc_id", "text_hash").agg(F.collect_list("data").alias("ranges")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            rows = []
            for doc_id, text, found in zip(chunk["doc_id"], chunk["text"], chunk["ranges"], strict=True):
                data, spans = (text or "").encode(), np.empty((0, 2), np.int64)
                if found:
                    pairs = np.frombuffer(b"".join(found), "<u4").reshape(-1, 2).astype(np.int64)
                    spans = _ranges(pairs[:, 0], pairs[:, 1] - pairs[:, 0] + 1 - WIDTH).astype(np.int64)
                kept, at = [], 0
                for a, b in spans.tolist():
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                rows.append((doc_id, len(data), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(b"".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    # always a shuffle by document: the ranges grow with the corpus, so their side is never broadcast
    return rows.join(ranges.hint("merge"), ["doc_id", "text_hash"], "left").select("doc_id", "text", "ranges").mapInArrow(run, schema)
