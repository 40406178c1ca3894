"""Headerless, unquoted, comma separated text tables (the reference's input format).

``split(value, sep, -1)`` keeps trailing empty fields, so a short row is seen as
short and goes to the quarantine output instead of silently shifting the class.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from votesel.operators.ranking import checked_broadcast


def _fields(sep: str):
    return F.split(F.col("value"), re.escape(sep), -1)


def field_count(lines: DataFrame, sep: str = ",", id_col: str = "row_id") -> int:
    """Arity of the first line (the reference takes the schema from row 1)."""
    first = lines.agg(F.min_by(F.size(_fields(sep)), F.col(id_col)).alias("n")).first()
    return int(first["n"]) if first and first["n"] is not None else 0


def parse_lines(
    lines: DataFrame,
    sep: str = ",",
    class_first: bool = False,
    n_fields: int | None = None,
    id_col: str = "row_id",
) -> DataFrame:
    """``row_id, value`` lines to ``row_id, att_0..att_{m-1}, class`` (all strings).

    With ``class_first`` the first field is the class and moves to the end.
    Lines whose arity differs from ``n_fields`` are left out (see ``quarantine_lines``).
    """
    if n_fields is None:
        n_fields = max(field_count(lines, sep, id_col), 1)
    arr = _fields(sep)
    idx = list(range(1, n_fields)) + [0] if class_first else list(range(n_fields))
    cols = [arr.getItem(i) for i in idx]
    names = [f"att_{j}" for j in range(n_fields - 1)] + ["class"]
    return lines.where(F.size(arr) == n_fields).select(
        F.col(id_col).alias("row_id"), *[c.alias(n) for c, n in zip(cols, names)]
    )


def quarantine_lines(lines: DataFrame, n_fields: int, sep: str = ",", id_col: str = "row_id") -> DataFrame:
    """Lines with the wrong number of fields, kept with their arity for inspection."""
    arr = _fields(sep)
    return lines.where(F.size(arr) != n_fields).select(
        F.col(id_col).alias("row_id"), "value", F.size(arr).alias("n_fields")
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``row_id, value`` of a text file or a folder of them; ``row_id`` counts lines from 0 in the order of
    file path, then position in the file, however Spark packs files and blocks into tasks.

    A block of a file is read by one task in one go, so a line's number is its place in its block plus the
    lines of the blocks before: one narrow counting scan and a table with a row per block."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_id"),
    )
    blocks = lines.groupBy("_file", "_at").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy(F.lit(0)).orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_file", "_at", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return lines.join(checked_broadcast(blocks), ["_file", "_at"]).select((F.col("_id") + F.col("_shift")).alias("row_id"), "value")


def read_text_table(
    spark: SparkSession, path: str, sep: str = ",", class_first: bool = False, n_fields: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Read text files: ``(rows, quarantined lines)``. The arity is ``n_fields``, or else that of the first line."""
    lines = read_lines(spark, path)
    if n_fields is None:
        n_fields = max(field_count(lines, sep), 1)
    return parse_lines(lines, sep, class_first, n_fields), quarantine_lines(lines, n_fields, sep)
