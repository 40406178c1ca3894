"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole; each turn is ``<s>[ROLE] role [/ROLE] text</s>``. Control strings
inside roles and texts get one backslash behind their opening bracket (more if some are there already),
so the template's own marks are the only ones left and unescaping is exact. The rendered string is encoded
once with offsets; the sorted spans of the turns to learn from are intersected with the sorted token spans
by binary search, which gives the token mask and the exact character spans under it.

Turns are ordered by turn number (null first), then role, then text; null role or text counts as empty.
Repeated rows are repeated turns; rows with null conv_id form one conversation. A conversation is the
unit of the result, so its turns are gathered in one place; different conversations are not.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votesel.llm.common import arrow_schema, tokenizer_path

#: The control strings. Each holds its opening bracket once, at the start, so none can begin
#: inside a text and end in the template.
CONTROLS = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, ROLE_END, CLOSE = "<s>[ROLE] ", " [/ROLE] ", "</s>"
_BODIES = sorted((c[1:] for c in CONTROLS), key=len, reverse=True)
_CONTROL = re.compile(r"([<\[])(\\*)(" + "|".join(re.escape(b) for b in _BODIES) + ")")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(" + "|".join(re.escape(b) for b in _BODIES) + ")")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\2\\\3", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text) if "\\" in text else text


@dataclass
class Rendered:
    """The rendered conversation and the sorted spans of the texts to learn from."""

    text: str
    loss: list[tuple[int, int]]


def render(turns: list[tuple[str, str]], learn_from: str = "assistant") -> Rendered:
    parts, loss, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + ROLE_END, escape(text)
        if role == learn_from:
            loss.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return Rendered("".join(parts), loss)


def read_back(text: str) -> list[tuple[str, str]]:
    """Turns of a rendered conversation."""
    turns, at = [], 0
    while at < len(text):
        mid = text.index("[/ROLE]", at)
        end = text.index(CLOSE, mid)
        turns.append((unescape(text[at + len(OPEN) : mid - 1]), unescape(text[mid + len(ROLE_END) - 1 : end])))
        at = end + len(CLOSE)
    return turns


def loss_mask(offsets: list[tuple[int, int]], loss: list[tuple[int, int]]) -> tuple[list[int], list[tuple[int, int]]]:
    """Indexes of the tokens that meet a loss span, and the character spans under the mask.

    ``offsets`` are sorted token spans. For each loss span the first and last token that meet it are found
    by binary search; a token that crosses the span's edge is cut at the edge. Tokens that share characters
    (pieces of one code point) all belong to the mask, the characters count once."""
    ends, starts = [e for _, e in offsets], [s for s, _ in offsets]
    tokens, spans = [], []
    for begin, stop in loss:
        first = bisect.bisect_right(ends, begin)
        last = bisect.bisect_left(starts, stop)
        tokens += range(first, last)
        at = begin
        for k in range(first, last):
            s, e = max(starts[k], at), min(ends[k], stop)
            if e > s:
                if spans and spans[-1][1] == s:
                    spans[-1] = (spans[-1][0], e)
                else:
                    spans.append((s, e))
                at = e
    return tokens, spans


_TOKENIZERS: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import AddedToken, Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = False
        tok.add_special_tokens([AddedToken(c, normalized=False) for c in CONTROLS])
        _TOKENIZERS[path] = tok
    return _TOKENIZERS[path]


def format_chats(conversations: DataFrame, learn_from: str = "assistant", vocab_path: str | None = None) -> DataFrame:
    """``conv_id, formatted, token_ids, loss_tokens, loss_starts, loss_stops`` per conversation.

    ``loss_tokens`` are the indexes of the tokens under the loss mask, ``loss_starts``/``loss_stops`` the
    character spans under it. One shuffle by conv_id."""
    schema = "conv_id long, formatted string, token_ids array<int>, loss_tokens array<int>, loss_starts array<int>, loss_stops array<int>"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer_path("byte_bpe_50k.json", vocab_path))
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200).to_pydict()
                shown = [render([(t["role"], t["text"]) for t in turns], learn_from) for turns in part["turns"]]
                coded = tok.encode_batch([r.text for r in shown], add_special_tokens=False)
                rows = []
                for conv_id, r, enc in zip(part["conv_id"], shown, coded, strict=True):
                    tokens, spans = loss_mask(enc.offsets, r.loss)
                    rows.append((conv_id, r.text, enc.ids, tokens, [s for s, _ in spans], [e for _, e in spans]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    chats = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    chats = chats.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    chats = chats.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return chats.mapInArrow(run, schema)


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digests read back from the formatted conversations: turns from the text, loss text from its spans."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                turns = read_back(r["formatted"])
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                loss = "".join(unescape(r["formatted"][s:e]) for s, e in zip(r["loss_starts"], r["loss_stops"], strict=True))
                rows.append((r["conv_id"], len(turns), _hex(said), len(loss), _hex(loss), len(r["formatted"]), r["n_tokens"], r["n_loss_tokens"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    sizes = [F.size("token_ids").cast("long").alias("n_tokens"), F.size("loss_tokens").cast("long").alias("n_loss_tokens")]
    return formatted.select("conv_id", "formatted", "loss_starts", "loss_stops", *sizes).mapInArrow(run, schema)


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
