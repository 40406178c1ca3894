"""Shared helpers of the text operators."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str, path: str | None = None) -> str:
    """Place of a public vocabulary file: ``path`` if given, else the installed library's own copy."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def text_chunks(batches: Iterable[pa.RecordBatch], chars: int = 4_000_000) -> Iterator[dict[str, list]]:
    """Rows of Arrow batches as column lists, cut so that the ``text`` column of a chunk holds about
    ``chars`` code points (a longer text is a chunk of its own). Bounds a task's memory, drops nothing."""
    for batch in batches:
        cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        texts, start, size = cols["text"], 0, 0
        for i, t in enumerate(texts):
            size += len(t) if t else 0
            if size >= chars:
                yield {n: c[start : i + 1] for n, c in cols.items()}
                start, size = i + 1, 0
        if start < len(texts):
            yield {n: c[start:] for n, c in cols.items()}


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a flat DDL string of the types that the operators return."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<boolean>": pa.list_(pa.bool_()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


WORDS = re.compile(r"\w+")
_CODES: dict[str, int] = {}


def tokens_of(text: str | None) -> list[str]:
    """Runs of word characters in lower case."""
    return WORDS.findall(text.lower()) if text else []


def token_codes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's tokens, the same on every machine. A worker keeps a bounded table of them."""
    if len(_CODES) > 500_000:
        _CODES.clear()
    known, out = _CODES, []
    for w in tokens_of(text):
        c = known.get(w)
        if c is None:
            c = xxhash.xxh64_intdigest(w)
            if len(w) < 100:
                known[w] = c
        out.append(c)
    return np.array(out, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection: distinct values stay distinct)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
