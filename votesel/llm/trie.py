"""Prefix trie of conversations by Spark SQL ``ROLLUP`` over positional turn-id columns.

A turn's id is a 128-bit digest of its role and text, with the text's length in code points behind it, so
texts are read once and never shuffled. A conversation becomes one row per block of ``WIDTH`` turns: columns
``t1`` to ``t8`` hold the ids and ``key`` the node at which the block before ended (empty for the root).
``GROUP BY key, ROLLUP (t1, ..., t8)`` then aggregates all prefixes of all blocks together; ``grouping_id``
tells a prefix's depth in its block, and rows whose last column is a real null (the conversation ended
before) are shallower nodes again and left out. Partial aggregation meets a very common first turn or a
conversation with many copies before the shuffle.

Sums over subtrees take a second rollup: each node's own value is carried by its smallest member alone, in
the column of its depth, and a prefix sums the columns from its depth on and what lies in further blocks.

A parent's smallest member is looked up only for nodes whose smallest member is not the parent's; the many
children of a common parent are spread over salts. The digest of the conversations that end at a node is
streamed over runs of sorted ids, as an end may have any number of them.

Null role or text counts as empty; turns go by number (null first), equal numbers by turn id; repeated rows
are repeated turns; rows without conv_id belong to no conversation. An empty table has no nodes. A single
conversation is one row of ids: its chain of blocks is sequential.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votesel.llm.common import arrow_schema
from votesel.session import materialize

#: Turns per block of columns.
WIDTH = 8
#: Children of one parent are spread over so many salts; ids of one end are sorted in runs of at most 2**9.
SALTS, RUN_BITS = 64, 9
DIGEST_BYTES = 16
COLUMNS = [f"t{i}" for i in range(1, WIDTH + 1)]


def _digest(data: Column) -> Column:
    return F.substring(F.unhex(F.sha2(data, 256)), 1, DIGEST_BYTES)


def turn_id(role: Column, text: Column) -> Column:
    """Digest of role and text, then the text's code points as four bytes."""
    of = _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return F.concat(of, F.unhex(F.lpad(F.hex(F.length(text).cast("long")), 8, "0")))


def _chars(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, DIGEST_BYTES + 1, 4)), 16, 10).cast("long")


def turn_lists(chats: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turn ids of each conversation in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = chats.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("k"), "turn", turn_id(role, text).alias("id")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts")).select("conv_id", F.transform("ts", lambda t: t["id"]).alias("turns"))


def shared_heads(lists: DataFrame, of: int = 100, most: int = 6) -> DataFrame:
    """``conv_id, turns`` rebuilt: the first h turns of conversation ``c - c % of``, then the own turns behind
    the first h, with ``h = crc32(c as decimal text) % most``."""
    heads = lists.where(F.col("conv_id") % of == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = lists.withColumn("base", F.col("conv_id") - F.col("conv_id") % of).withColumn("h", h)
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<binary>"))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def turn_blocks(lists: DataFrame) -> DataFrame:
    """``conv_id, at, key, t1 .. t8, end``: block number, the node before the block, its turns, and in a
    conversation's last block the node at which it ends."""
    schema = ", ".join(["conv_id long", "at long", "key binary", *[f"{c} binary" for c in COLUMNS], "end binary"])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = b""
                for at in range(max(1, -(-len(turns) // WIDTH))):
                    block = turns[at * WIDTH : (at + 1) * WIDTH]
                    node = hashlib.sha256(key + b"".join(block)).digest()[:DIGEST_BYTES] if block else key
                    last = (at + 1) * WIDTH >= len(turns)
                    rows.append((conv_id, at, key, *block, *[None] * (WIDTH - len(block)), node if last else None))
                    key = node
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return lists.select("conv_id", "turns").mapInArrow(run, schema)


def prefix_rollup(blocks: DataFrame, aggregates: list[str]) -> DataFrame:
    """One row per trie node: ``level`` in its block (0: the root), ``at``, ``key``, ``t1 .. t8`` and the SQL aggregates."""
    turns = ", ".join(COLUMNS)
    grouped = blocks.sparkSession.sql(f"SELECT key, {turns}, grouping_id() AS rolled, min(at) AS at, {', '.join(aggregates)} FROM {{blocks}} GROUP BY key, ROLLUP ({turns})", blocks=blocks)
    level = F.lit(WIDTH) - F.bit_count("rolled").cast("int")
    last = F.get(F.array(*COLUMNS), F.col("level") - 1)
    ended = F.when(F.col("level") == 0, F.col("at") > 0).otherwise(last.isNull())
    return grouped.withColumn("level", level).where(~ended).drop("rolled")


def _node(drop: int = 0) -> Column:
    """Id of a rollup row's prefix without its last ``drop`` turns, as ``turn_blocks`` names block ends."""
    turns = [F.coalesce(F.when(F.col("level") - drop >= i, F.col(c)), F.lit(b"")) for i, c in enumerate(COLUMNS, 1)]
    return F.when(F.col("level") - drop <= 0, F.col("key")).otherwise(_digest(F.concat("key", *turns)))


def ends_digest(blocks: DataFrame) -> DataFrame:
    """``node, ends_sha256``: digest of the comma-joined ascending conv_ids that end at a node."""
    schema = "node binary, ends_sha256 string"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for of, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if of != node:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = of, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=arrow)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], schema=arrow)

    ends = blocks.where("end IS NOT NULL").select(F.col("end").alias("node"), "conv_id", F.shiftright("conv_id", RUN_BITS).alias("run"))
    runs = ends.groupBy("node", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return runs.repartition("node").sortWithinPartitions("node", "run").select("node", "ids").mapInArrow(run, schema)


def parent_members(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``parent_conv_id``, the parent's smallest member (null for the root)."""
    top = F.col("depth") == F.min("depth").over(Window.partitionBy("conv_id"))
    marked = nodes.withColumn("top", top & (F.col("depth") > 0)).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    asking = marked.where("top")
    members = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    spread = asking.select("parent", "salt").distinct().join(members, "parent")
    inherited = F.when(F.col("depth") > 0, F.col("conv_id"))
    return marked.where("NOT top").withColumn("parent_conv_id", inherited).unionByName(asking.join(spread, ["parent", "salt"])).drop("top", "salt")


def prefix_trie(lists: DataFrame) -> DataFrame:
    """``node, parent, turn, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256`` per distinct prefix of the conversations ``conv_id, turns``.

    ``turn`` is the id of the node's last turn, ``conv_id`` its smallest member."""
    blocks = materialize(turn_blocks(lists))
    grouped = prefix_rollup(blocks, ["count(*) AS n_convs", "min(conv_id) AS conv_id"])
    turn = F.get(F.array(*COLUMNS), F.col("level") - 1)
    parent = F.when(F.col("level") > 0, _node(1))
    nodes = materialize(grouped.select(_node().alias("node"), parent.alias("parent"), turn.alias("turn"), (F.col("at") * WIDTH + F.col("level")).alias("depth"), "conv_id", "n_convs"))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))

    # each node's value at its smallest member: one row per member and block, one column per turn of the block
    own = nodes.where("depth > 0").select("conv_id", F.expr(f"(depth - 1) div {WIDTH}").alias("at"), ((F.col("depth") - 1) % WIDTH + 1).alias("i"), ((F.col("n_convs") - 1) * _chars(F.col("turn"))).alias("value"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    values = [F.sum(F.when(F.col("i") == i, F.col("value")).otherwise(0)).alias(f"v{i}") for i in range(1, WIDTH + 1)]
    carried = own.groupBy("conv_id", "at").agg(*values, F.sum("value").alias("all"), F.sum("leaf").alias("leaf"))
    whole = Window.partitionBy("conv_id")
    further = whole.orderBy(F.desc("at"))
    filled = blocks.drop("end").join(carried, ["conv_id", "at"], "left").fillna(0, [f"v{i}" for i in range(1, WIDTH + 1)] + ["all", "leaf"])
    filled = filled.withColumn("rest", F.coalesce(F.sum("all").over(further.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("leaves", F.sum("leaf").over(further)).withColumn("carries", F.max("leaf").over(whole) + F.max("all").over(whole))
    sums = prefix_rollup(filled.where("carries > 0"), [f"sum(v{i}) AS v{i}" for i in range(1, WIDTH + 1)] + ["sum(rest) AS rest", "sum(leaves) AS n_leaves"])
    saved = sum((F.when(F.col("level") <= i, F.col(f"v{i}")).otherwise(0) for i in range(1, WIDTH + 1)), F.col("rest"))
    sums = sums.select(_node().alias("node"), saved.alias("saved_tokens"), "n_leaves")

    out = parent_members(nodes).join(sums, "node", "left").join(ends_digest(blocks), "node", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    n_leaves = F.greatest(F.coalesce("n_leaves", F.lit(0)), F.lit(1)).cast("long").alias("n_leaves")
    saved_tokens = F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens")
    return out.select("node", "parent", "turn", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", n_leaves, saved_tokens, F.coalesce("ends_sha256", none).alias("ends_sha256"))


def last_turns(nodes: DataFrame, chats: DataFrame) -> DataFrame:
    """``nodes`` with ``role`` and ``text`` of each node's last turn (null for the root)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    texts = chats.select(turn_id(role, text).alias("turn"), role.alias("role"), text.alias("text")).groupBy("turn").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    return nodes.join(texts, "turn", "left")
