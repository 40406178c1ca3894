"""BPE encoding and decoding with a priority queue of merge ranks over a doubly linked symbol list.

The vocabulary file is a public tokenizer description (NFC, lower case, white space dropped, byte-level
symbols, ``</w>`` on the last symbol of a word). Words are encoded once per worker and kept in a bounded
table, so the merge loop only sees words that are new to the worker.

Null text counts as the empty text: no tokens, empty decoded text. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votesel.llm.common import arrow_schema, text_chunks, tokenizer_path

#: Fixed value: the word pattern that the vocabulary file states, with its white space written out.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE + r"\p{L}\p{N}]+"
WORD_END = "</w>"


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte value: printable bytes stand for themselves, the others
    take the code points from 256 on, in order."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, keep_words: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.strings = {i: s for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + WORD_END] for s in symbols]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merged = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {(a, b): r for r, (a, b, _) in reversed(list(enumerate(self.merged)))}
        self.words = regex.compile(WORDS)
        self.marks = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        self.keep_words = keep_words
        self.known: dict[str, tuple[bytes, str]] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply merges by (rank, position) until no adjacent pair has a rank."""
        n = len(symbols)
        if n < 2:
            return symbols
        rank, merged = self.rank, self.merged
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [r * n + i for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            r, i = divmod(heapq.heappop(queue), n)
            a, b, new = merged[r]
            j = right[i]
            if j < 0 or symbols[i] != a or symbols[j] != b:  # stale: one side was merged meanwhile
                continue
            symbols[i], symbols[j] = new, -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (r := rank.get((new, symbols[k]))) is not None:
                    heapq.heappush(queue, r * n + i)
            h = left[i]
            if h >= 0 and (r := rank.get((symbols[h], new))) is not None:
                heapq.heappush(queue, r * n + h)
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the vocabulary strings joined by a space."""
        raw = word.encode()
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.final[raw[-1]]
        ids = self.merge(symbols)
        out = struct.pack(f"<{len(ids)}I", *ids), " ".join([self.strings[i] for i in ids])
        if len(raw) < 200:
            if len(self.known) >= self.keep_words:
                self.known.clear()
            self.known[word] = out
        return out

    def plain(self, text: str) -> list[tuple[bytes, str]]:
        """Encoded words of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case by character: no final sigma
        known, word = self.known, self.word
        return [known.get(w) or word(w) for w in self.words.findall(text.lower())]

    def encode_parts(self, text: str) -> list[tuple[bytes, str]]:
        if "<|" not in text:
            return self.plain(text)
        parts, at = [], 0
        for m in self.marks.finditer(text):
            parts += self.plain(text[at : m.start()])
            parts.append((struct.pack("<I", self.special[m[0]]), m[0]))
            at = m.end()
        return parts + self.plain(text[at:])

    def encode(self, text: str | None) -> bytes:
        """Token ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join([p[0] for p in self.encode_parts(text or "")])

    def decode(self, ids: bytes) -> str:
        """Vocabulary strings of the ids (the file names no decoder, so they are joined by a space)."""
        return " ".join([self.strings[i] for (i,) in struct.iter_unpack("<I", ids)])


_ENCODERS: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    """One encoder per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordBpe(path)
    return _ENCODERS[path]


def bpe_encode(docs: DataFrame, vocab_path: str | None = None, ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded`` of each row's whole text.

    ``ids=False`` returns the digests ``ids_sha256`` and ``decoded_sha256`` in place of ids and decoded
    text. One narrow pass: no shuffle, memory bounded by one batch and the worker's word table."""
    schema = "doc_id long, n_tokens long, " + ("ids binary, decoded string" if ids else "ids_sha256 string, decoded_sha256 string")
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path("word_bpe_49k.json", vocab_path))
        for chunk in text_chunks(batches):
            out: tuple[list, list, list] = ([], [], [])
            for text in chunk["text"]:
                parts = bpe.encode_parts(text or "")
                coded = b"".join([p[0] for p in parts])
                decoded = " ".join([p[1] for p in parts])
                out[0].append(len(coded) // 4)
                out[1].append(coded if ids else hashlib.sha256(coded).hexdigest())
                out[2].append(decoded if ids else hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((chunk["doc_id"], *out), arrow.types)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
