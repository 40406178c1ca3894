"""Registered queries of the text operators, each with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from votesel.llm.bpe import bpe_encode
from votesel.llm.chat import chat_digests, format_chats
from votesel.llm.common import table
from votesel.llm.decontam import find_leaks
from votesel.llm.extract import extract_pages
from votesel.llm.fingerprints import edited_fingerprints
from votesel.llm.langid import predict_languages, train_on_split
from votesel.llm.linededup import line_report
from votesel.llm.nearcopies import near_copies
from votesel.llm.oracles import QUALITY_SQL, RANKED_SQL, SECRETS_SQL, TRIE_SQL
from votesel.llm.quality import quality_cascade
from votesel.llm.ranked import ranked_search
from votesel.llm.secrets import secret_report
from votesel.llm.substrings import remove_repeats
from votesel.llm.trie import prefix_trie, shared_heads, turn_lists


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7 whose two turns say control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(format_chats(chats.unionByName(extra)))


def op3_nearcopies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade(table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), ids=False)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, train_on_split(docs))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"), all_holders=True)


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of its hundred's first one."""
    nodes = prefix_trie(shared_heads(turn_lists(table(spark, sf_dir, "conversations"))))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_chat": op2_chat,
    "op3_nearcopies": op3_nearcopies,
    "op4_extract": op4_extract,
    "op5_quality": op5_quality,
    "op6_substrings": op6_substrings,
    "op7_bpe": op7_bpe,
    "op8_langid": op8_langid,
    "op9_secrets": op9_secrets,
    "op10_linededup": op10_linededup,
    "op11_ranked": op11_ranked,
    "op12_trie": op12_trie,
    "op13_fingerprints": op13_fingerprints,
}

ORACLES: dict[str, str] = {
    "op5_quality": QUALITY_SQL,
    "op9_secrets": SECRETS_SQL,
    "op11_ranked": RANKED_SQL,
    "op12_trie": TRIE_SQL,
}
