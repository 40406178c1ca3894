import random
import struct

import corpus_pipeline
from tokenizers import Tokenizer

import public_tokenizers
from votesel.llm.common import tokens_of

WORDS = {"en": "the house and tree of light water stone river with a small bird that sings in old town", "de": "das haus und der baum von licht wasser stein fluss mit einem kleinen vogel der singt in alten stadt"}


def similarity(a, b):
    bag = lambda t: {tuple(w[i : i + 5]) for w in [tokens_of(t)] for i in range(len(w) - 4)}
    x, y = bag(a), bag(b)
    return len(x & y) / max(len(x | y), 1)


def test_stages_against_plain_expectations(spark, tmp_path):
    rng = random.Random(9)

    def prose(lang, n):
        return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "", "s", "en", "ly"]) for _ in range(n))

    rows, kept = [], {}
    for k in range(40):
        lang = "en" if k % 2 else "de"
        kept[k] = "\n".join(prose(lang, 40) for _ in range(4))
        rows.append((k, kept[k], lang, "s", len(kept[k])))
    passage = prose("en", 60)
    bench = prose("en", 25)
    rows[3] = (3, kept[3] + "\n" + passage, "en", "s", 0)
    kept[3] = rows[3][1]
    later = prose("en", 45)
    rows.append((50, later + "\n" + passage, "en", "s", 0))  # loses the passage, stays
    kept[50] = later
    rows.append((51, kept[5], "en", "s", 0))  # an exact copy: nothing is left
    rows.append((52, kept[7].replace("\n", " ") + " more", "en", "s", 0))  # a near copy on other lines
    rows.append((53, prose("en", 30) + " " + bench + " " + prose("en", 30), "en", "s", 0))  # a leak
    rows.append((54, "12 34 !! 56", "en", "s", 0))  # no letters
    rows.append((55, None, None, "s", None))
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    assert similarity(kept[7], rows[42][1]) >= 0.8
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        gone = before - {r.doc_id for r in docs.select("doc_id").collect()}
        assert gone == {"language ID": {54, 55}, "line dedup": {51}, "near-dedup": {52}, "benchmark decontamination": {53}}[name]
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert set(out) == set(kept)
    for doc_id, text in kept.items():
        ids = lib.encode(text, add_special_tokens=False).ids
        assert bytes(out[doc_id].ids) == struct.pack(f"<{len(ids)}I", *ids), doc_id


def test_empty_documents(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
