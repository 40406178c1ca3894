"""Schema inference, nominal domains, encodings, casting and the long "cells" layout.

A labelled table is wide: ``row_id, <features...>, class``. Features are numeric
(double) or nominal (string with a closed domain); the class is always nominal.
The attribute list (one entry per column, ``m`` entries) is schema-sized and is
the only thing brought to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from votesel.operators.ranking import ROWS_PER_TASK, checked_broadcast, exact_row_number
from votesel.session import materialize

NUMERIC = "numeric"
NOMINAL = "nominal"
CLASS = "class"


def column(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Attr:
    idx: int
    name: str
    kind: str  # NUMERIC or NOMINAL


def feature_columns(df: DataFrame, label: str = "class", id_col: str = "row_id") -> list[str]:
    return [c for c in df.columns if c not in (label, id_col)]


def infer_attributes_df(
    df: DataFrame, label: str = "class", id_col: str = "row_id", strict: bool = False
) -> DataFrame:
    """``idx, feature, kind`` for every column, class last.

    Typed columns keep their type (non-string = numeric). String columns follow
    the reference rule: numeric when the first row's value parses as a double
    (``try_cast``); with ``strict`` only when every value parses.
    """
    feats = feature_columns(df, label, id_col)
    types = dict(df.dtypes)
    str_cols = [c for c in feats if types[c] == "string"]
    if str_cols and not strict:
        one = df.agg(F.min_by(F.struct(*[column(c) for c in str_cols]), F.col(id_col)).alias("r"))
        probe = {c: F.col("r").getField(c).try_cast("double").isNotNull() for c in str_cols}
    elif str_cols:
        one = df.agg(*[F.count_if(column(c).try_cast("double").isNull()).alias(c) for c in str_cols])
        probe = {c: column(c) == 0 for c in str_cols}
    else:
        one = df.sparkSession.range(1)
        probe = {}
    rows = []
    for i, c in enumerate(feats):
        kind = F.when(probe[c], F.lit(NUMERIC)).otherwise(F.lit(NOMINAL)) if c in probe else F.lit(NUMERIC)
        rows.append(F.struct(F.lit(i).alias("idx"), F.lit(c).alias("feature"), kind.alias("kind")))
    rows.append(F.struct(F.lit(len(feats)).alias("idx"), F.lit(label).alias("feature"), F.lit(CLASS).alias("kind")))
    return one.select(F.inline(F.array(*rows)))


def infer_attributes(df: DataFrame, label: str = "class", id_col: str = "row_id", strict: bool = False) -> list[Attr]:
    """Feature attributes (class excluded), in column order."""
    types = dict(df.dtypes)
    feats = feature_columns(df, label, id_col)
    if all(types[c] != "string" for c in feats):
        return [Attr(i, c, NUMERIC) for i, c in enumerate(feats)]
    rows = infer_attributes_df(df, label, id_col, strict).where(F.col("kind") != CLASS).collect()
    return [Attr(r["idx"], r["feature"], r["kind"]) for r in sorted(rows, key=lambda r: r["idx"])]


def typed_attributes(df: DataFrame, label: str = "class", id_col: str = "row_id") -> list[Attr]:
    """Attributes straight from a typed schema: string = nominal, everything else numeric."""
    types = dict(df.dtypes)
    return [
        Attr(i, c, NOMINAL if types[c] == "string" else NUMERIC)
        for i, c in enumerate(feature_columns(df, label, id_col))
    ]


def cast_numeric(df: DataFrame, attrs: Sequence[Attr]) -> DataFrame:
    """Cast numeric attributes to double. A value that does not parse raises (ANSI), as in the reference."""
    num = {a.name for a in attrs if a.kind == NUMERIC}
    return df.select(*[column(c).cast("double").alias(c) if c in num else column(c) for c in df.columns])


def class_counts(df: DataFrame, label: str = "class") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_priors(df: DataFrame, label: str = "class") -> DataFrame:
    """``class, n, p`` with ``p = n / N``."""
    counts = class_counts(df, label)
    return counts.select(
        F.col(label).alias("class"),
        F.col("n"),
        (F.col("n") / F.sum("n").over(_whole())).alias("p"),
    )


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def drop_rare_classes(df: DataFrame, min_count: int = 2, label: str = "class") -> DataFrame:
    """Drop rows of classes with fewer than ``min_count`` rows (semi join on the class counts)."""
    keep = class_counts(df, label).where(F.col("n") >= min_count).select(label)
    return df.join(checked_broadcast(keep), label, "left_semi")


def melt_cells(df: DataFrame, attrs: Sequence[Attr], label: str = "class", id_col: str = "row_id") -> DataFrame:
    """Long layout ``row_id, class, idx, feature, num, cat``: one record per (row, feature).

    A generator (no shuffle); consumers aggregate by feature so no record grows with the row count.
    """
    cells = [
        F.struct(
            F.lit(a.idx).alias("idx"),
            F.lit(a.name).alias("feature"),
            (column(a.name).cast("double") if a.kind == NUMERIC else F.lit(None).cast("double")).alias("num"),
            (column(a.name).cast("string") if a.kind == NOMINAL else F.lit(None).cast("string")).alias("cat"),
        )
        for a in attrs
    ]
    return df.select(F.col(id_col).alias("row_id"), F.col(label).alias("class"), F.inline(F.array(*cells)))


def nominal_domains(df: DataFrame, attrs: Sequence[Attr], label: str = "class", id_col: str = "row_id") -> DataFrame:
    """``feature, value, code``: distinct values of every nominal feature, code 1-based in sorted order."""
    nom = [a for a in attrs if a.kind == NOMINAL]
    schema = T.StructType(
        [T.StructField("feature", T.StringType()), T.StructField("value", T.StringType()), T.StructField("code", T.IntegerType())]
    )
    if not nom:
        return df.sparkSession.createDataFrame([], schema)
    distinct = melt_cells(df, nom, label, id_col).select("feature", F.col("cat").alias("value")).distinct()
    distinct = materialize(distinct)
    biggest = distinct.groupBy("feature").count().agg(F.max("count")).first()[0] or 0
    bucket = F.substring("value", 1, 2) if biggest > ROWS_PER_TASK else None
    ranked = exact_row_number(distinct, ["feature"], [F.col("value")], bucket, out="code")
    return ranked.select("feature", "value", F.col("code").cast("int").alias("code"))


def encoded_cells(
    df: DataFrame,
    attrs: Sequence[Attr],
    domains: DataFrame | None = None,
    label: str = "class",
    id_col: str = "row_id",
) -> DataFrame:
    """``row_id, class, idx, feature, x``: numeric value, or the 1-based nominal code."""
    cells = melt_cells(df, attrs, label, id_col)
    if not any(a.kind == NOMINAL for a in attrs):
        return cells.select("row_id", "class", "idx", "feature", F.col("num").alias("x"))
    if domains is None:
        domains = nominal_domains(df, attrs, label, id_col)
    dom = checked_broadcast(domains.select("feature", F.col("value").alias("cat"), "code"))
    joined = cells.join(dom, ["feature", "cat"], "left")
    return joined.select("row_id", "class", "idx", "feature", F.coalesce("num", F.col("code").cast("double")).alias("x"))


def project_selected(
    df: DataFrame, attrs: Sequence[Attr], features: Sequence[str], label: str = "class", id_col: str = "row_id"
) -> DataFrame:
    """Keep the selected features in attribute order, class last."""
    keep = set(features)
    cols = [column(a.name) for a in sorted(attrs, key=lambda a: a.idx) if a.name in keep]
    return df.select(id_col, *cols, label)
