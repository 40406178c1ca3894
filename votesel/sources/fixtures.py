"""Labelled tables built from the driver's parquet tables (see FIXTURES.md).

Each returns a wide DataFrame ``row_id, <features...>, class`` where numeric
features are ``double`` and nominal ones ``string``. Only the needed columns are
read, so the parquet scan prunes everything else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class planted from the quantity band, plus a noisy copy and noise columns."""
    li = _table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    row_id = F.md5(F.concat_ws("|", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), cents))
    q = F.col("l_quantity")
    return li.select(
        row_id.alias("row_id"),
        q.cast("double").alias("qty"),
        (q + 20 * F.col("l_discount")).cast("double").alias("qty_disc"),
        F.col("l_extendedprice").cast("double").alias("price"),
        F.col("l_discount").cast("double").alias("disc"),
        F.col("l_tax").cast("double").alias("tax"),
        F.col("l_linenumber").cast("double").alias("line"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.when(q <= 17, "low").when(q <= 34, "mid").otherwise("high").alias("class"),
    )


def lineitem_nominal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 with the quantity and three nominal features: many rows share a vector."""
    b = lineitem_band(spark, sf_dir)
    return b.select("row_id", "qty", F.col("line").cast("bigint").cast("string").alias("line"), "flag", "status", "class")


def doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text statistics of labelled documents, class = quality."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    words = F.split(F.col("text"), " ")
    n_words = F.size(words).cast("double")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("row_id"),
        F.col("n_chars").cast("double").alias("n_chars"),
        n_words.alias("n_words"),
        (F.length(F.regexp_replace("text", "[^A-Za-z]", "")) / F.greatest(F.length("text"), F.lit(1)))
        .cast("double")
        .alias("alpha_ratio"),
        (F.size(F.array_distinct(words)) / n_words).cast("double").alias("uniq_ratio"),
        F.col("lang"),
        F.col("source"),
        F.col("quality").cast("string").alias("class"),
    )


def embedding_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one double column per embedding dimension (as many as the longest vector has), class = label
    (vertical mode input)."""
    emb = _table(spark, sf_dir, "embeddings")
    dims = emb.agg(F.max(F.size("embedding"))).first()[0] or 0
    return emb.select(
        F.col("vec_id").alias("row_id"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(f"att_{i}") for i in range(dims)],
        F.col("label").cast("string").alias("class"),
    )


def customer_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account balance and nation (nominal), class = market segment."""
    c = _table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("row_id"),
        F.col("c_acctbal").cast("double").alias("c_acctbal"),
        F.col("c_nationkey").cast("string").alias("c_nationkey"),
        F.col("c_mktsegment").alias("class"),
    )


def order_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """total price and priority (nominal), class = order status."""
    o = _table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_totalprice").cast("double").alias("o_totalprice"),
        F.col("o_orderpriority").alias("o_orderpriority"),
        F.col("o_orderstatus").alias("class"),
    )


def band_lines(spark: SparkSession, sf_dir: str, class_first: bool = False) -> DataFrame:
    """Text lines ``row_id, value`` serialised from the band table (integers and strings only,
    so both engines print them identically). Stands in for a headerless CSV file."""
    b = lineitem_band(spark, sf_dir)
    fields = [
        F.col("qty").cast("bigint").cast("string"),
        F.col("line").cast("bigint").cast("string"),
        F.col("flag"),
        F.col("status"),
    ]
    cls = F.col("class")
    parts = [cls, *fields] if class_first else [*fields, cls]
    return b.select("row_id", F.concat_ws(",", *parts).alias("value"))


def ragged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines ``value`` of the band table in which every seventh line item of an order lacks its status."""
    b = lineitem_band(spark, sf_dir)
    ends = [F.col("flag"), F.when(F.col("line") != 7, F.col("status")), F.col("class")]  # concat_ws leaves null out
    return b.select(F.concat_ws(",", F.col("qty").cast("bigint"), F.col("line").cast("bigint"), *ends).alias("value"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items labelled by their order key: single-line orders are one-row classes
    (input for the rare-class filter)."""
    li = _table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    row_id = F.md5(F.concat_ws("|", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), cents))
    return li.select(
        row_id.alias("row_id"),
        F.col("l_quantity").cast("double").alias("qty"),
        F.col("l_orderkey").cast("string").alias("class"),
    )
