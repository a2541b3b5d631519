"""Prefix trie of conversations by ROLLUP over positional turn columns.

A conversation's turns become ids in positional columns ``t1 .. t8`` of a block.
``GROUP BY block, prior, ROLLUP (t1, .. t8)`` aggregates every prefix of every
conversation in one pass; ``grouping_id`` tells its depth.  A longer conversation
goes on in further blocks, keyed by the node in which the block before ended.

Sums over subtrees need no walk.  A node's weight is booked on its smallest member
at the node's depth; running sums from a conversation's end give what it brings to
each of its prefixes, and a second ROLLUP adds that up over the members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanvigil.llm.running import running_sums
from spanvigil.session import drop_table, materialise

#: Positional columns of a block.
WIDTH = 8
SLOTS = [f"t{i}" for i in range(1, WIDTH + 1)]

#: Conversation ids of a node's ends are listed in pieces of so many neighbouring ids.
PIECE_BITS = 8


def turn_ids(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, id``; an id is 128 bits of a digest of role and text, then the text's bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    named = F.concat(F.substring(digest, 1, 32), F.lit("-"), F.octet_length(text).cast("string"))
    return turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), named.alias("id"))


def positions(turns: DataFrame) -> DataFrame:
    """``conv_id, position, id``: turns in order of turn (null first), then of id."""
    counted = turns.groupBy("conv_id", "turn", "id").agg(F.count("*").alias("n"))
    order = [F.col("turn").asc_nulls_first(), F.col("id").asc()]
    last = running_sums(counted, ["conv_id"], order, "n", "last")
    places = F.explode(F.sequence(F.col("last") - F.col("n") + 1, F.col("last")))
    return last.select("conv_id", places.alias("position"), "id")


def rebuilt_turns(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations and their turns.

    ``conv_id, length`` and ``conv_id, position, id``: conversation c takes the first
    h turns of conversation c - c % 5, then its own turns after its first h.
    """
    lengths = materialise(placed.groupBy("conv_id").agg(F.max("position").alias("own")))
    lent = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    convs = lengths.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % 5).alias("lender"), lent.alias("h"))
    lenders = lengths.select(F.col("conv_id").alias("lender"), F.least("own", F.lit(8)).alias("has"))
    taken = F.least(F.col("h"), F.coalesce("has", F.lit(0)))
    convs = materialise(convs.join(lenders, "lender", "left").withColumn("taken", taken))
    heads = placed.where("position <= 8").select(F.col("conv_id").alias("lender"), "position", "id")
    borrowed = convs.join(heads, "lender").where("position <= taken").select("conv_id", "position", "id")
    own = placed.join(convs.select("conv_id", "h", "taken"), "conv_id").where("position > h")
    own = own.select("conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("position"), "id")
    length = F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return convs.select("conv_id", length.alias("length")), borrowed.unionByName(own)


def _name(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws(",", *parts).cast("binary"), 256)


def _blocks(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """``conv_id, block, prior, own, t1 .. t8``; a conversation without turns has one empty block.

    ``own`` names the node in which a full block ends, ``prior`` that of the block
    before; in front of the first block stands the root, named ''.  Names of later
    blocks take in all blocks before them by doubling: each round joins a block with
    the one as far back as the round before reached.
    """
    slot = (F.col("position") - 1) % WIDTH + 1
    columns = [F.max(F.when(slot == i, F.col("id"))).alias(t) for i, t in enumerate(SLOTS, 1)]
    filled = turns.groupBy("conv_id", F.expr(f"(position - 1) div {WIDTH}").alias("block")).agg(*columns)
    silent = convs.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("block"), *[F.lit(None).cast("string").alias(t) for t in SLOTS])
    filled = materialise(filled.unionByName(silent).withColumn("own", F.when(F.col(SLOTS[-1]).isNotNull(), _name(F.lit(""), *SLOTS))))
    longer = convs.where(F.col("length") > WIDTH).select("conv_id")
    names = materialise(filled.where("own is not null").join(longer, "conv_id", "left_semi").select("conv_id", "block", "own"))
    most, step = names.agg(F.max("block")).first()[0] or 0, 1
    while step <= most:
        back = names.select("conv_id", (F.col("block") + step).alias("block"), F.col("own").alias("before"))
        grown = F.when(F.col("before").isNotNull(), _name("before", "own")).otherwise(F.col("own"))
        following = materialise(names.join(back, ["conv_id", "block"], "left").select("conv_id", "block", grown.alias("own")))
        drop_table(names)
        names, step = following, step * 2
    before = names.select("conv_id", (F.col("block") + 1).alias("block"), F.col("own").alias("prior"))
    first = filled.where("block = 0").withColumn("prior", F.lit(""))
    later = filled.where("block > 0").drop("own").join(before, ["conv_id", "block"]).join(names, ["conv_id", "block"], "left")
    return materialise(first.unionByName(later))


def _rollup(blocks: DataFrame, **aggregates: str) -> DataFrame:
    """One row per node: ``key, parent_key, depth, last_id`` and the aggregates (SQL over the members)."""
    spark = blocks.sparkSession
    grouped = spark.sql(
        f"SELECT block, prior, {', '.join(SLOTS)}, min(own) AS own, "
        f"{WIDTH} - length(replace(bin(grouping_id()), '0', '')) AS inside, "
        + ", ".join(f"{sql} AS {name}" for name, sql in aggregates.items())
        + f" FROM {{blocks}} GROUP BY block, prior, ROLLUP({', '.join(SLOTS)})",
        blocks=blocks,
    )
    inside, last = F.col("inside"), F.element_at(F.array(*SLOTS), F.greatest(F.col("inside").cast("int"), F.lit(1)))
    nodes = grouped.withColumn("last_id", last).where("inside = 0 and block = 0 or inside > 0 and last_id is not null")

    def named(depth: Column) -> Column:
        path = [F.when(depth >= i, F.col(t)) for i, t in enumerate(SLOTS, 1)]
        return F.when(depth == 0, F.col("prior")).when(depth == WIDTH, F.col("own")).otherwise(_name("prior", *path))

    return nodes.select(
        named(inside).alias("key"),
        F.when((F.col("block") > 0) | (inside > 0), named(inside - 1)).alias("parent_key"),
        (F.col("block") * WIDTH + inside).alias("depth"),
        "last_id",
        *aggregates,
    )


def _hashed_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each key's joined pieces; pieces come sorted and keys are never cut between tasks."""
    key, digest = None, None
    for batch in batches:
        keys, digests = [], []
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name == key:
                digest.update(b",")
            else:
                if digest is not None:
                    keys.append(key)
                    digests.append(digest.hexdigest())
                key, digest = name, hashlib.sha256()
            digest.update(ids.encode())
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "ends_sha256": pa.array(digests, pa.string())})
    if digest is not None:
        yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [digest.hexdigest()]})


def _ends(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """``key, ends_sha256``: digest of the ids that end in a node, listed in order.

    A list may be of any length: its pieces are bounded and stream through one digest.
    """
    last = F.greatest(F.expr(f"(length - 1) div {WIDTH}"), F.lit(0))
    ending = blocks.join(convs.select("conv_id", last.alias("block"), "length"), ["conv_id", "block"])
    key = F.when(F.col("length") == 0, F.lit("")).when(F.col("own").isNotNull(), F.col("own")).otherwise(_name("prior", *SLOTS))
    piece = F.shiftright("conv_id", PIECE_BITS).alias("piece")
    lists = ending.groupBy(key.alias("key"), piece).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    dealt = lists.repartition("key").sortWithinPartitions("key", "piece").select("key", "ids")
    return dealt.mapInArrow(_hashed_lists, "key string, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``.  Rows without a conv_id belong to no conversation; a null role or
    text is empty; turns with equal numbers stand in order of their id, a digest of
    role and text, and repeated rows count as often as they occur.  A table without
    conversations has no nodes, not even a root.  Turns are compared by 128 bits of
    SHA-256 and nodes by 256.
    """
    placed = materialise(positions(turn_ids(conversations)))
    convs, turns = rebuilt_turns(placed)
    convs = materialise(convs)
    blocks = _blocks(convs, turns)
    drop_table(placed)
    counts = _rollup(blocks, conv_id="min(conv_id)", n_convs="count(*)")
    size = F.coalesce(F.element_at(F.split("last_id", "-"), 2).cast("long"), F.lit(0))
    nodes = materialise(counts.select("key", "parent_key", "depth", "conv_id", "n_convs", ((F.col("n_convs") - 1) * size).alias("weight")))
    below = nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("key"))
    children = materialise(below.agg(F.count("*").alias("n_children")))
    childless = nodes.join(children, "key", "left_anti").select("conv_id", F.lit(1).alias("leaf"))

    # Weights at the slots of the smallest member's blocks, summed from its end.
    slot = (F.col("depth") - 1) % WIDTH + 1
    booked = nodes.where("depth > 0").groupBy("conv_id", F.expr(f"(depth - 1) div {WIDTH}").alias("block"))
    booked = booked.agg(*[F.sum(F.when(slot == i, F.col("weight"))).alias(f"w{i}") for i in range(1, WIDTH + 1)])
    weights = [F.coalesce(f"w{i}", F.lit(0)).alias(f"w{i}") for i in range(1, WIDTH + 1)]
    grid = blocks.select("conv_id", "block").join(booked, ["conv_id", "block"], "left").select("conv_id", "block", *weights)
    grid = grid.withColumn("all", reduce(Column.__add__, [F.col(f"w{i}") for i in range(1, WIDTH + 1)]))
    summed = running_sums(grid, ["conv_id"], [F.col("block").desc()], "all", "tail")
    tails = [(F.col("tail") - reduce(Column.__add__, [F.col(f"w{j}") for j in range(1, i)], F.lit(0))).alias(f"s{i}") for i in range(1, WIDTH + 1)]
    carried = summed.select("conv_id", "block", *tails).join(childless, "conv_id", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0)))
    weighed = blocks.join(carried, ["conv_id", "block"]).where("s1 > 0 or leaf > 0")
    sums = _rollup(weighed, n_leaves="sum(leaf)", **{f"s{i}": f"sum(s{i})" for i in range(1, WIDTH + 1)})
    place = F.greatest((F.col("depth") - 1) % WIDTH + 1, F.lit(1)).cast("int")
    sums = sums.select("key", "n_leaves", F.element_at(F.array(*[f"s{i}" for i in range(1, WIDTH + 1)]), place).alias("saved_tokens"))

    above = nodes.join(children, "key").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(sums, "key", "left").join(children, "key", "left").join(_ends(blocks, convs), "key", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return found.join(above, "parent_key", "left").select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce("n_leaves", F.lit(0)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
