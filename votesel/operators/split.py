"""Row identity, the stratified train/test split and the random partitionings.

All randomness is an md5 order key (``hash_key``), so results are reproducible
and DuckDB can recompute them. Exact ranks go through ``exact_row_number`` so a
big class never lands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votesel.functions.exprs import hash_key, hex_fraction
from votesel.operators.attributes import Attr, column
from votesel.operators.ranking import (
    ROWS_PER_TASK,
    checked_broadcast,
    exact_row_number,
    hex_digits_for,
    md5_bucket,
    quantile_bucket,
    sort_tasks,
)
from votesel.session import materialize

# Rows of one (round, class) that share a bucket when rows are dealt with their columns.
ROWS_PER_BUCKET = 2_000
# Most hex digits of such a bucket: the offsets have a row per round, class and bucket.
MOST_DIGITS = 3
# Columns of at most so many values travel as codes; which have few is guessed from so many rows.
FEW_VALUES = 1_000
SAMPLE_ROWS = 200_000
# Classes are counted by so many first characters of the id, for the ranks of the split.
PREFIX = 2


def _max_class_rows(df: DataFrame, keys: Sequence[str]) -> int:
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _order_bucket(
    df: DataFrame, keys: Sequence[str], order_col: str, biggest: int, rows_per_task: int = ROWS_PER_TASK
) -> tuple[DataFrame, Column | None]:
    """Order-preserving bucket for ``order_col``: hex prefix for md5 strings, quantiles for numbers."""
    if biggest <= rows_per_task:
        return df, None
    if dict(df.dtypes)[order_col] == "string":
        return df, md5_bucket(F.col(order_col), biggest, rows_per_task)
    tmp = df.withColumn("_ord", F.col(order_col).cast("double"))
    tmp, bucket = quantile_bucket(tmp, keys, "_ord", biggest, rows_per_task)
    return tmp, bucket


def assign_folds(
    df: DataFrame, label: str = "class", id_col: str = "row_id", folds: int = 3, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Add ``fold = (rank of the row inside its class by row_id - 1) mod folds``.

    The reference numbers each class in file order and sends index % 3 == 0 to test.
    """
    text = dict(df.dtypes)[id_col] == "string"
    prefix = (F.substring(column(id_col), 1, PREFIX) if text else F.lit(None).cast("string")).alias("_bkt")
    is_md5 = F.coalesce(column(id_col).rlike("^[0-9a-f]{32}$"), F.lit(True)) if text else F.lit(False)
    counts = materialize(df.groupBy(column(label).alias("_l"), prefix).agg(F.count(F.lit(1)).alias("count"), F.bool_and(is_md5).alias("_md5")))
    sizes = counts.groupBy("_l").agg(F.sum("count").alias("n"), F.bool_and("_md5").alias("_md5"))
    total, biggest, md5 = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.bool_and("_md5")).first()
    b, bucket = _order_bucket(df, [label], id_col, biggest, rows_per_task)
    offsets, digits = None, hex_digits_for(biggest, rows_per_task)
    if bucket is not None and text and digits <= PREFIX:
        below = Window.partitionBy("_l").orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
        held = counts.groupBy("_l", F.substring("_bkt", 1, digits).alias("_bkt")).agg(F.sum("count").alias("n"))
        offsets = held.select(F.col("_l").alias(label), "_bkt", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("_off_n"))
    read = {c: column(c) for c in df.columns}
    if md5:
        # md5 ids travel as 16 bytes, which have the same order
        if bucket is not None:
            b, bucket = b.withColumn("_prefix", bucket), F.col("_prefix")
        b = b.withColumn(id_col, F.unhex(column(id_col)))
        read[id_col] = F.lower(F.hex(column(id_col))).alias(id_col)
    ranked = exact_row_number(b, [label], [column(id_col)], bucket, "_rn", offsets, total)
    out = ranked.withColumn("fold", F.pmod(F.col("_rn") - 1, F.lit(folds)).cast("int"))
    return out.select(*read.values(), "fold")


def train_test_split(
    df: DataFrame,
    label: str = "class",
    id_col: str = "row_id",
    test_df: DataFrame | None = None,
    folds: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """Stratified, deterministic split: fold 0 is test, the rest train.

    With a supplied test table, train is every row and test is that table unfiltered.
    """
    if test_df is not None:
        return df, test_df
    f = assign_folds(df, label, id_col, folds)
    return f.where(F.col("fold") != 0).drop("fold"), f.where(F.col("fold") == 0).drop("fold")


def horizontal_assignment(
    df: DataFrame,
    parts: int,
    rounds: int = 5,
    seed: int = 42,
    mode: str = "rank",
    label: str = "class",
    id_col: str = "row_id",
) -> DataFrame:
    """``round, part, row_id`` for every round: rows of each class dealt over the parts.

    ``mode='rank'`` (reference semantics): rank inside (round, class) by
    md5(seed|round|row_id), part = (rank - 1) mod P, so per class the parts differ by at
    most one row. ``mode='hash'``: part = md5 mod P, no shuffle at all, balanced only in
    expectation.
    """
    if parts < 1:
        raise ValueError("parts must be positive")
    keys = df.select(F.col(id_col).alias("row_id"), F.col(label).alias("class")).withColumn(
        "round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))
    )
    keys = keys.withColumn("_h", hash_key(seed, F.col("round"), F.col("row_id")))
    if mode == "hash":
        part = F.pmod(F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint"), F.lit(parts))
        return keys.select("round", part.cast("int").alias("part"), "row_id")
    if mode != "rank":
        raise ValueError(f"unknown partition mode {mode!r}")
    return _ranked_assignment(df.select(column(id_col).alias("row_id"), column(label).alias("class")), parts, rounds, seed)


def _ranked_assignment(ids: DataFrame, parts: int, rounds: int, seed: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``horizontal_assignment`` by rank. Every id is shuffled once per round, so it travels alone: md5 ids as 16 bytes, class
    and round as one number; the order key is computed before the shuffle to place a row and again after it."""
    text = dict(ids.dtypes)["row_id"] == "string"
    is_md5 = F.coalesce(F.col("row_id").rlike("^[0-9a-f]{32}$"), F.lit(True)) if text else F.lit(False)
    classes = materialize(ids.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.bool_and(is_md5).alias("_md5")))
    total, biggest, md5 = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.bool_and("_md5")).first()
    coded = materialize(classes.select(F.col("class").alias("_label"), F.monotonically_increasing_id().alias("_c")))
    rows = ids.join(checked_broadcast(coded), F.col("class").eqNullSafe(F.col("_label")))
    row_id = F.unhex("row_id") if md5 else F.col("row_id")
    rows = rows.select(row_id.alias("row_id"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"), "_c")
    rows = rows.select("row_id", (F.col("_c") * F.lit(rounds + 1) + F.col("round")).alias("_g"))
    text_id = F.lower(F.hex("row_id")) if md5 else F.col("row_id")
    key = hash_key(seed, F.pmod("_g", F.lit(rounds + 1)).cast("int"), text_id)
    digits = hex_digits_for(biggest, rows_per_task)
    groups, place = ["_g"], [F.col("_g")]
    if digits:
        groups, place = ["_g", "_bkt"], [F.col("_g"), F.substring(key, 1, digits)]
    placed = rows.repartition(*sort_tasks(rows, total * rounds), *place)
    if digits:
        placed = placed.withColumn("_bkt", F.substring(key, 1, digits))
    ranked = placed.withColumn("_rn", F.row_number().over(Window.partitionBy(*groups).orderBy(F.unhex(key))))
    if digits:
        held = rows.groupBy("_g", F.substring(key, 1, digits).alias("_bkt")).count()
        below = Window.partitionBy("_g").orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
        offsets = held.select("_g", "_bkt", F.coalesce(F.sum("count").over(below), F.lit(0)).alias("_off"))
        ranked = ranked.join(checked_broadcast(offsets), groups).withColumn("_rn", F.col("_rn") + F.col("_off"))
    part = F.pmod(F.col("_rn") - 1, F.lit(parts)).cast("int")
    return ranked.select(F.pmod("_g", F.lit(rounds + 1)).cast("int").alias("round"), part.alias("part"), text_id.alias("row_id"))


def horizontal_partition(
    df: DataFrame,
    parts: int,
    rounds: int = 5,
    seed: int = 42,
    mode: str = "rank",
    label: str = "class",
    id_col: str = "row_id",
) -> DataFrame:
    """The rows with their ``round, part`` (each row once per round)."""
    assign = horizontal_assignment(df, parts, rounds, seed, mode, label, id_col)
    return assign.join(df.withColumnRenamed(id_col, "row_id"), "row_id")


def horizontal_rows(
    df: DataFrame,
    parts: int,
    rounds: int = 5,
    seed: int = 42,
    label: str = "class",
    id_col: str = "row_id",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``round, part`` and the columns of ``df`` but its id, as ``horizontal_partition`` (rank mode) has them."""
    return deal_rows(df, parts, rounds, seed, label, id_col, rows_per_bucket)[0]


def _few_values(df: DataFrame, cols: Sequence[str], n: int) -> dict[str, list]:
    """All values but null of the double and string columns that have few. A bounded sample proposes the columns."""
    types = dict(df.dtypes)
    cols = [c for c in cols if types[c] in ("double", "string")]
    if not cols or not n:
        return {}
    some = df.sample(min(1.0, SAMPLE_ROWS / n), 7).agg(*[F.approx_count_distinct(column(c)).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    cols = [c for i, c in enumerate(cols) if some[f"d{i}"] <= FEW_VALUES]
    if not cols:
        return {}
    held = df.agg(*[F.collect_set(column(c)).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    return {c: sorted(held[f"v{i}"], key=lambda v: (v != v, v)) for i, c in enumerate(cols) if len(held[f"v{i}"]) <= FEW_VALUES}


def deal_rows(
    df: DataFrame,
    parts: int,
    rounds: int = 5,
    seed: int = 42,
    label: str = "class",
    id_col: str = "row_id",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> tuple[DataFrame, DataFrame]:
    """The dealt rows (``horizontal_rows``) and their ``round, part`` pairs.

    The columns travel through the one shuffle that ranks the rows and the rank is kept per bucket of the md5
    key, so no id is shuffled or written for every round and nothing is joined back. The order key is a bucket
    of one hex digit or more and the next 60 bits. Columns of few values travel as the digits of one number and
    are written as codes. Ids that repeat are rare: only theirs are carried along, since each of their places
    holds every row of that id.
    """
    if parts < 1:
        raise ValueError("parts must be positive")
    cols = [c for c in df.columns if c != id_col]
    biggest = _max_class_rows(df, [label])
    digits = max(1, min(hex_digits_for(biggest, rows_per_bucket), MOST_DIGITS))
    row_id = column(id_col)
    repeated = materialize(df.groupBy(F.xxhash64(row_id).alias("_x")).count().where("count > 1 OR _x = 42").select("_x"))  # 42: null
    marked, repeats = df, not repeated.isEmpty()
    if repeats:
        marked = df.withColumn("_x", F.xxhash64(row_id)).join(checked_broadcast(repeated.withColumn("_many", F.lit(True))), "_x", "left").drop("_x")
    # code 0 is null, code i the i-th value; the packed number has a digit per column
    packed, radix = {}, 1
    n = df.count()
    few = _few_values(df, cols, n)
    labels = F.array(*map(F.lit, few[label])) if few.get(label) else None
    for c, values in few.items():
        if c != label and radix * (len(values) + 1) < 2**62:
            packed[c] = (F.array(*map(F.lit, values)), radix, len(values) + 1) if values else (None, radix, 1)
            radix *= len(values) + 1
    wide = [c for c in cols if c not in packed and c != label]
    digit = [
        F.coalesce(F.array_position(values, column(c)), F.lit(0)) * F.lit(r) for c, (values, r, _) in packed.items() if values is not None
    ]
    coded_label = column(label) if labels is None else F.coalesce(F.array_position(labels, column(label)), F.lit(0)).cast("int")
    held_cols = [column(id_col).alias("_id"), coded_label.alias("_label"), *[column(c).alias(f"_w{i}") for i, c in enumerate(wide)]]
    dealt = marked.select(*held_cols, sum(digit, F.lit(0).cast("bigint")).alias("_p"), *(["_many"] if repeats else []))
    # neighbours that share most values compress well in the shuffle
    dealt = dealt.sortWithinPartitions("_p").withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    dealt = dealt.withColumn("_h", hash_key(seed, F.col("_round"), F.col("_id")))
    bkt = F.conv(F.substring("_h", 1, digits), 16, 10).cast("int") * F.lit(rounds + 1) + F.col("_round")
    # bucket and class are one number where the class has a code
    groups = {"_bkt": bkt, "_label": F.col("_label")} if labels is None else {"_g": bkt * F.lit(len(few[label]) + 1) + F.col("_label")}
    kept = [f"_w{i}" for i in range(len(wide))]
    dealt = dealt.select(
        *kept,
        *[value.alias(c) for c, value in groups.items()],
        "_p",
        *([F.when(F.col("_many"), F.col("_id")).alias("_id"), F.coalesce("_many", F.lit(False)).alias("_many")] if repeats else []),
        F.conv(F.substring("_h", digits + 1, 15), 16, 10).cast("bigint").alias("_o"),
    )
    many = sort_tasks(df, n * rounds)
    if many:
        dealt = dealt.repartition(*many, *groups)
    place = F.row_number().over(Window.partitionBy(*groups).orderBy("_o"))
    codes = [F.expr(f"CAST((_p DIV {r}L) % {size} AS INT)").alias(f"_c{i}") for i, (_, r, size) in enumerate(packed.values())]
    ranked = dealt.withColumn("_rn", F.pmod(place - 1, F.lit(parts)).cast("int"))
    ranked = materialize(ranked.select(*kept, *codes, *groups, "_rn", *(["_id", "_many"] if repeats else [])))
    if labels is not None:
        split = {"_bkt": f"CAST(_g DIV {len(few[label]) + 1} AS INT)", "_label": f"_g % {len(few[label]) + 1}"}
    else:
        split = {c: c for c in groups}
    held = ranked.groupBy(*groups).count().selectExpr("count", *[c for c in groups if c not in split], *[f"{e} AS {c}" for c, e in split.items()])
    held = held.withColumn("_round", F.pmod("_bkt", F.lit(rounds + 1)))
    below = Window.partitionBy("_round", "_label").orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(
        *[F.col(c).alias(f"_of{c}") for c in groups], F.pmod(F.coalesce(F.sum("count").over(below), F.lit(0)), F.lit(parts)).cast("int").alias("_off")
    )
    # an equality that holds for nulls looks up two columns, so it is kept for classes without a code
    same = F.lit(True)
    for c in groups:
        same = same & (F.col(c).eqNullSafe(F.col(f"_of{c}")) if c == "_label" else F.col(c) == F.col(f"_of{c}"))
    out = ranked.join(checked_broadcast(offsets), same).withColumn("_part", ((F.col("_rn") + F.col("_off")) % parts).cast("int"))
    out = out.withColumns({c: F.expr(e) for c, e in split.items()}).withColumn("_round", F.pmod("_bkt", F.lit(rounds + 1)))
    place = [F.col("_round").alias("round"), F.col("_part").alias("part")]
    back = F.col("_label") if labels is None else F.when(F.col("_label") > 0, F.get(labels, F.col("_label") - 1))
    read = {label: back, **{c: F.col(f"_w{i}") for i, c in enumerate(wide)}}
    for i, (c, (values, _, _)) in enumerate(packed.items()):
        none = F.lit(None).cast(dict(df.dtypes)[c])
        read[c] = none if values is None else F.when(F.col(f"_c{i}") > 0, F.get(values, F.col(f"_c{i}") - 1))
    columns = [read[c].alias(c) for c in cols]
    if not repeats:
        # every class starts at part 0 and goes round
        places = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
        places = places.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(min(parts, biggest) - 1)) if biggest else F.array().cast("array<int>")))
        return out.select(*place, *columns), places
    held = marked.where("_many").select(row_id.alias("_id"), *[column(c) for c in cols])
    many = out.where("_many").select(*place, "_id").join(held, "_id").select("round", "part", *[column(c) for c in cols])
    out = out.where("NOT _many").select(*place, *columns).unionByName(many)
    return out, materialize(out.select("round", "part").distinct())


def vertical_partition(
    attrs_df: DataFrame,
    parts: int,
    rounds: int = 5,
    seed: int = 42,
    overlap: float = 0.0,
) -> DataFrame:
    """``round, part, idx, feature, shared`` from the attribute table (``idx, feature``).

    Features whose md5 fraction is below ``overlap`` go to every part (``shared``);
    the rest are ranked by md5(seed|round|feature) and dealt over the parts. The
    table is schema-sized (rounds x parts x features at most).
    """
    if parts < 1:
        raise ValueError("parts must be positive")
    a = attrs_df.select("idx", "feature").withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    a = a.withColumn("_h", hash_key(seed, F.col("round"), F.col("feature")))
    a = a.withColumn("shared", hex_fraction(hash_key(seed, F.col("round"), F.col("feature"), "overlap")) < F.lit(overlap))
    own = a.where(~F.col("shared"))
    w = Window.partitionBy("round").orderBy("_h")
    own = own.select("round", F.pmod(F.row_number().over(w) - 1, F.lit(parts)).cast("int").alias("part"), "idx", "feature", "shared")
    shared = a.where(F.col("shared")).select(
        "round", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "idx", "feature", "shared"
    )
    return own.unionByName(shared)


def attrs_frame(spark, attrs: Sequence[Attr]) -> DataFrame:
    """The attribute list as a DataFrame ``idx, feature, kind`` (m rows)."""
    return spark.createDataFrame([(a.idx, a.name, a.kind) for a in attrs], "idx int, feature string, kind string")
