"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

1. language ID: documents without a language (no letters) or with an undecided one go;
2. line dedup: aligned common blocks go from the later documents; documents left without a word go;
3. near-dedup: one document of each near-duplicate class stays;
4. benchmark decontamination: documents with a verified leak go;
5. BPE: every document is encoded and decoded back (the result has ids and texts per document).

Every stage but the last returns the columns of its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votesel.llm.bpe import bpe_encode
from votesel.llm.common import table
from votesel.llm.decontam import find_leaks
from votesel.llm.langid import predict_languages_of, train_on_split
from votesel.llm.linededup import dedup_lines
from votesel.llm.nearcopies import near_copies
from votesel.session import materialize

#: A document whose best language has less than this posterior has none.
LEAST_SCORE = 0.5


def rows_of(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and the whole ``row``, so that no column of the documents meets an operator's own."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a predicted language."""
    found = predict_languages_of(rows_of(docs), train_on_split(docs))
    return found.where((F.col("_found.lang_pred") != "und") & (F.col("_found.score") >= LEAST_SCORE)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes aligned common blocks out of the later documents; a document that loses all its words goes."""
    out = dedup_lines(rows_of(docs), all_holders=True)
    left = (F.col("_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars").cast("long"))}
    return out.where(left).select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each near-duplicate class, with all its rows if it is repeated."""
    going = near_copies(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(going, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every document that is left."""
    return bpe_encode(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE", bpe),
]

#: SQL expresses none of the model, alignment, signature and merge stages; tests/llm/test_pipeline.py
#: holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
