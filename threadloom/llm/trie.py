"""Prefix trie of rebuilt conversations, rolled up by bands of depth.

A node is a sequence of first turns, named by its depth and the exclusive or of one 128-bit hash per
(place, turn); texts themselves are never shuffled. Subtree sums take a band of ``height`` depths at a
time: a node is exploded to its ancestors inside its band only, which completes everything but what
lies in deeper bands. Band roots then form a trie of their own, ``height`` times less deep, that is
summed in the same way, and the completed total of every band root goes to its ancestors in the band
above. So the explosion is at most ``height`` and the rounds are the logarithm of the depth.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.ordered import digests, earlier_sum, in_order
from threadloom.session import written

KEY = ["depth", "k1", "k2"]
#: Turns of one conversation that a window takes together.
BLOCK = 4096
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, t1, t2, chars): the turns of all conversations in one order, ``at`` without gaps.

    Turns are ordered by ``turn``, nulls first, then by role and hash, so ties have a fixed order. A
    null role or text is empty. Rows with a null conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), role, text).alias("t2"),
        F.length(text).cast("bigint").alias("chars"),
    )
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("t1"), F.asc("t2")]
    stored = in_order(turns, order, "turns")
    ahead = earlier_sum(stored.groupBy("part").agg(F.count(F.lit(1)).alias("rows")), [], "part", "rows", "ahead")
    return stored.join(ahead, "part").select("conv_id", (F.col("ahead") + F.col("idx")).alias("at"), "t1", "t2", "chars")


def rebuilt(turns: DataFrame, shared: Column, base: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """The turns and sizes of conversations that open with turns of their base conversation.

    Conversation c takes the first h turns of its base (all if fewer), then its own after its first h.
    ``shared`` gives h, ``most`` at most, and ``base`` the base, both from ``conv_id``. Gives
    (conv_id, depth, t1, t2, chars, size) with depth from 1, and (conv_id, size), sizes of 0 included.
    """
    counted = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("start"))
    asked = counted.select("conv_id", "n", "start", shared.cast("bigint").alias("h"), base.alias("base"))
    held = counted.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least(F.col("h"), F.coalesce("base_n", F.lit(0)))
    convs = written(asked.join(held, "base", "left").withColumn("taken", taken).withColumn("size", taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "convs")
    place = F.col("at") - F.col("start") + 1
    own = turns.join(convs, "conv_id").where(place > F.col("h")).select("conv_id", (place - F.col("h") + F.col("taken")).alias("depth"), "t1", "t2", "chars", "size")
    heads = turns.join(convs.select("conv_id", "start"), "conv_id").where(place <= most)
    heads = heads.select(F.col("conv_id").alias("base"), place.alias("depth"), "t1", "t2", "chars")
    opened = heads.join(convs.select("conv_id", "base", "taken", "size"), "base").where(F.col("depth") <= F.col("taken"))
    return own.union(opened.select("conv_id", "depth", "t1", "t2", "chars", "size")), convs.select("conv_id", "size")


def prefix_paths(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, chars, size): the key of every prefix, and of its parent.

    Prefixes are running sums inside blocks of ``BLOCK`` turns, to which earlier blocks are added, so
    a conversation of any length fills many tasks. The root is depth 0.
    """
    place = F.floor(F.col("depth") / BLOCK)
    mixed = [F.xxhash64(F.lit(i), "t1", "t2", "depth").alias(f"m{i}") for i in (1, 2)]
    steps = turns.select("conv_id", "depth", "chars", "size", place.alias("block"), *mixed)
    running = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = steps.select("*", *[F.bit_xor(f"m{i}").over(running).alias(f"r{i}") for i in (1, 2)])
    totals = steps.groupBy("conv_id", "block").agg(*[F.bit_xor(f"m{i}").alias(f"b{i}") for i in (1, 2)])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("conv_id", "block", *[F.bit_xor(f"b{i}").over(before).alias(f"o{i}") for i in (1, 2)]).where(F.col("block") > 0)
    keyed = inside.join(offsets, ["conv_id", "block"], "left")
    whole = [F.col(f"r{i}").bitwiseXOR(F.coalesce(f"o{i}", F.lit(0).cast("bigint"))) for i in (1, 2)]
    paths = keyed.select(
        "conv_id", "depth", *[w.alias(f"k{i}") for i, w in enumerate(whole, 1)],
        *[w.bitwiseXOR(F.col(f"m{i}")).alias(f"p{i}") for i, w in enumerate(whole, 1)], "chars", "size",
    )
    zero = F.lit(0).cast("bigint")
    roots = sizes.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"), zero.alias("chars"), "size")
    return paths.union(roots)


def subtree_sums(paths: DataFrame, nodes: DataFrame, values: Sequence[str], height: int = 16) -> DataFrame:
    """(depth, k1, k2, conv_id, values) with the sums of each value over the subtree of every node.

    ``paths`` is (conv_id, depth, k1, k2), ``nodes`` adds up to one row per node with one of its
    members as ``conv_id``; the smallest is kept. Both should be stored tables.
    """
    if height < 2:
        raise ValueError("a band has at least two depths")
    band = F.floor(F.col("depth") / height)
    lists = paths.groupBy("conv_id", band.alias("band")).agg(F.collect_list(F.struct(*KEY)).alias("line"))  # at most height

    def sent(rows: DataFrame, to: Column, ends: Column) -> DataFrame:
        """The values of ``rows`` at their ancestors in band ``to``, of a depth up to ``ends``."""
        placed = rows.withColumn("band", to).withColumnRenamed("depth", "own").drop("k1", "k2")
        lines = placed.join(lists, ["conv_id", "band"]).withColumn("ends", ends)
        met = lines.select("conv_id", *values, F.explode(F.filter("line", lambda n: n["depth"] <= F.col("ends"))).alias("n"))
        return met.select("n.*", "conv_id", *values)

    def added(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), *[F.sum(v).alias(v) for v in values])

    inside = written(added(sent(nodes, band, F.col("own"))), "bands")
    deepest = inside.agg(F.max("depth")).first()[0]
    if deepest is None or deepest < height:
        return inside
    every = F.col("depth") % height == 0
    up = (F.col("depth") / height).cast("bigint").alias("depth")
    roots = inside.where(every).select(up, "k1", "k2", "conv_id", *values)
    complete = subtree_sums(written(paths.where(every).select("conv_id", up, "k1", "k2"), "root_paths"), roots, values, height)
    passed = sent(complete.where(F.col("depth") > 0), F.col("depth") - 1, F.col("own") * height)
    return added(inside.unionByName(passed))


def rolled_up(turns: DataFrame, sizes: DataFrame, height: int = 16) -> DataFrame:
    """One row per node of the trie of (conv_id, depth, t1, t2, chars, size) turns.

    Gives conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256. Repeated conversations are members of the same nodes;
    members need not have turns. No conversations give no nodes, not even a root.
    """
    paths = written(prefix_paths(turns, sizes), "paths")
    grouped = paths.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    )
    nodes = written(grouped, "nodes")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    below = nodes.where(F.col("depth") > 0).groupBy(*parent).agg(F.count(F.lit(1)).alias("n_children"))
    counted = written(nodes.join(below, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))), "counted")
    own = counted.select(
        *KEY, "conv_id", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )
    sums = subtree_sums(paths.select("conv_id", *KEY), own, ["n_leaves", "saved_tokens"], height).drop("conv_id")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    ends = paths.where(F.col("depth") == F.col("size")).select(*KEY, "conv_id", F.col("conv_id").cast("string").alias("id"))
    ends = digests(ends, KEY, ["conv_id"], "id", ",", "ends_sha256")
    whole = counted.join(sums, KEY).join(ends, KEY, "left").join(above, ["depth", "p1", "p2"], "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )
