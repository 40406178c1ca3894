import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from votesel.llm.bpe import WordBpe, bpe_encode

PATH = public_tokenizers.path("word_bpe_49k.json")
TRICKY = ["", " ", "a", "It's WE'LL don’t 123 4.5", "<|endoftext|>x<|startoftext|> <|endof", "ΑΣ ΣΑΣ İstanbul ß ẞ", "é é ẛ̣", "tab\tnl\n\x0b\x0c\r\x1c\x1d\x85\xa0 ​　z", "日本語 テキスト 😀😀 ١٢٣ ²³ Ⅳ", "'S 'Re x'tt 'd", "aaaa" * 300, "!?!?... --- \x00\x01", "</w> a</w>", "ǅ ǆ ﬁ Å"]


@pytest.fixture(scope="module")
def both():
    return WordBpe(PATH, keep_words=50), Tokenizer.from_file(PATH)


def agree(own, lib, text):
    ids = lib.encode(text, add_special_tokens=False).ids
    coded = own.encode(text)
    assert list(struct.unpack(f"<{len(coded) // 4}I", coded)) == ids, repr(text)
    assert own.decode(coded) == lib.decode(ids, skip_special_tokens=False)


def test_tricky_texts_match_library(both):
    for text in TRICKY:
        agree(*both, text)


def test_random_texts_match_library(both):
    rng = random.Random(1)
    pools = ["abc the'sd SLL", "éèüßñÀÉ", " \n\t.,;:!?<|>endoftext", "0123456789", "ДЖжя中文字한글"]
    for _ in range(400):
        agree(*both, "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 80))))


def test_operator(spark):
    lib = Tokenizer.from_file(PATH)
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (2, None, "x"), (None, "", None), (3, "long word " * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe_encode(docs, ids=False).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for doc_id, text, _ in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert by[doc_id].n_tokens == len(ids)
        assert by[doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert by[doc_id].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    full = bpe_encode(docs).where("doc_id = 1").first()
    assert full.decoded == "hello</w> world</w>" and len(full.ids) == 8
    assert bpe_encode(docs.limit(0)).count() == 0
