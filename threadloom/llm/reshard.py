"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new capacities.

Sizes per old shard are summed, and a transportation problem between old and new shards (staying is
free, a moved byte costs one, or any given costs) is solved by shortest augmenting paths: its nodes are
shards, never rows. Each flow is a range of the bytes of its old shard, so a row's place in its old
shard says where it goes. Rows too large to be cut so finely are placed one by one beforehand; their
number is bounded because their sizes are.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.ordered import earlier_sum, with_place
from threadloom.session import written

#: A row above this part of a mean new shard is placed by itself: at most PARTS rows per new shard.
PARTS = 64


def least_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[int]]) -> list[list[int]]:
    """Flows (old, new) that carry all of ``supply`` within ``capacity`` at the least cost.

    Successive shortest paths with potentials over shards. Costs must not be negative; capacities
    below the supplies in sum are an error.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards cannot hold the old ones")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    high = [0] * (n + m)
    while any(left):
        gap: list[float] = [float("inf")] * (n + m)
        come = [-1] * (n + m)
        queue = [(0, i) for i in range(n) if left[i]]
        for _, i in queue:
            gap[i] = 0
        heapq.heapify(queue)
        done = [False] * (n + m)
        while queue:
            _, u = heapq.heappop(queue)
            if done[u]:
                continue
            done[u] = True
            if u < n:
                arcs = [(n + j, cost[u][j]) for j in range(m)]
            else:
                arcs = [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]]
            for v, price in arcs:
                reduced = gap[u] + price + high[u] - high[v]
                if reduced < gap[v]:
                    gap[v], come[v] = reduced, u
                    heapq.heappush(queue, (reduced, v))
        end = min((n + j for j in range(m) if room[j]), key=lambda v: (gap[v] + high[v], v))
        for v in range(n + m):
            high[v] += min(gap[v], gap[end])
        way = [end]
        while come[way[-1]] >= 0:
            way.append(come[way[-1]])
        way.reverse()
        amount = min(left[way[0]], room[end - n], *[flow[v][u - n] for u, v in zip(way, way[1:]) if u >= n])
        for u, v in zip(way, way[1:]):
            if u < n:
                flow[u][v - n] += amount
            else:
                flow[v][u - n] -= amount
        left[way[0]] -= amount
        room[end - n] -= amount
    return flow


def levelled(loads: Sequence[int], weights: Sequence[float], total: int) -> list[int]:
    """Capacities that add up to ``total`` and raise ``loads`` to the same level per weight where they can."""
    order = sorted(range(len(loads)), key=lambda i: loads[i] / weights[i])
    for count in range(len(order), 0, -1):
        used = order[:count]
        level = (total + sum(loads[i] for i in used)) / sum(weights[i] for i in used)
        if level * weights[used[-1]] >= loads[used[-1]]:
            break
    given = [0] * len(loads)
    for i in used:
        given[i] = max(0, int(level * weights[i]) - loads[i])
    for turn in range(total - sum(given)):
        given[used[turn % len(used)]] += 1
    while sum(given) > total:
        given[max(used, key=lambda i: given[i])] -= sum(given) - total
    return given


def plan(
    old: dict[int, int], large: Sequence[tuple[int, int]], weights: Sequence[float], cost: Sequence[Sequence[int]] | None = None
) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Byte ranges (old shard, from, to, new shard) and the new shard of each large row.

    ``old`` has the bytes of small rows per old shard, ``large`` the (old shard, bytes) of large ones.
    Large rows are placed by size: a row stays where its shard has room for it, else goes where most is
    left. New shards then take small bytes up to a common level per weight. A number that is no new
    shard (a shard given up, or -1 for rows without one) only gives bytes away.
    """
    total = sum(old.values()) + sum(size for _, size in large)
    share = sum(weights)
    limits = [total * w / share for w in weights]
    loads, placed = [0] * len(weights), [0] * len(large)
    for i in sorted(range(len(large)), key=lambda i: (-large[i][1], i)):
        shard, size = large[i]
        if not (0 <= shard < len(weights) and loads[shard] + size <= limits[shard]):
            shard = max(range(len(weights)), key=lambda j: (limits[j] - loads[j], -j))
        loads[shard] += size
        placed[i] = shard
    names = sorted(old)
    supply = [old[s] for s in names]
    price = cost or [[0 if s == j else 1 for j in range(len(weights))] for s in names]
    flow = least_cost_flow(supply, levelled(loads, weights, sum(supply)), price)
    ranges = []
    for s, row in zip(names, flow):
        at = 0
        for j, amount in sorted(enumerate(row), key=lambda x: (x[0] != s, x[0])):
            if amount:
                ranges.append((s, at, at + amount, j))
                at += amount
    return ranges, placed


def resharded(rows: DataFrame, old: Column, size: Column, weights: Sequence[float]) -> DataFrame:
    """``rows`` with ``size``, ``old``, their new ``shard`` and ``slot``, gapless from 0 in each shard.

    Sizes of the new shards, in proportion to ``weights``, are equal up to a row per byte range and the
    room that large rows leave. A null ``old`` shard counts as -1, so its rows count as moved; sizes
    must be 1 or more. Rows of equal content, id or size are told apart by their place in the stored
    table, so no group of them is brought together. Empty tables give no rows. Columns of ``rows``
    named like a result are replaced.
    """
    made = {"size": size.cast("bigint"), "old": F.coalesce(old, F.lit(-1)).cast("int")}
    kept = [c for c in rows.columns if c not in (*made, "shard", "slot", "part", "idx")]
    stored = written(with_place(rows.select(*kept, *[c.alias(n) for n, c in made.items()])), "sizes")
    total = stored.agg(F.sum("size")).first()[0] or 0
    limit = total // (PARTS * len(weights))
    found = stored.where(F.col("size") > limit).select("part", "idx", "old", "size").collect()  # fewer than PARTS per new shard
    big = {(r["part"], r["idx"]): (r["old"], r["size"]) for r in sorted(found)}
    small = F.when(F.col("size") > limit, 0).otherwise(F.col("size"))
    per_part = written(stored.groupBy("old", "part").agg(F.sum(small).alias("bytes")), "small")
    supply = {r["old"]: r["bytes"] for r in per_part.groupBy("old").agg(F.sum("bytes").alias("bytes")).collect()}
    ranges, placed = plan(supply, list(big.values()), weights)
    spark = rows.sparkSession
    flows = spark.createDataFrame(ranges, "giver int, low long, high long, to int")
    alone = spark.createDataFrame([(*at, to) for at, to in zip(big, placed)], "part int, idx long, alone int")
    ahead = earlier_sum(per_part, ["old"], "part", "bytes", "ahead").select("old", "part", "ahead")
    before = Window.partitionBy("part", "old").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(small).over(before), F.lit(0).cast("bigint"))
    spots = stored.repartition("part").withColumn("inside", inside).join(ahead, ["old", "part"])
    middle = 2 * (F.col("ahead") + F.col("inside")) + small
    spots = spots.withColumn("middle", F.when(F.col("size") > limit, None).otherwise(middle))
    met = (F.col("middle") >= 2 * F.col("low")) & (F.col("middle") < 2 * F.col("high")) & (F.col("old") == F.col("giver"))
    sent = spots.join(F.broadcast(flows), met, "left").join(F.broadcast(alone), ["part", "idx"], "left")
    moved = written(sent.select(*kept, "size", "old", "part", "idx", F.coalesce("alone", "to").alias("shard")), "moved")
    counts = moved.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = earlier_sum(counts, ["shard"], "part", "n", "earlier").select("shard", "part", "earlier")
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("idx")) - 1
    slots = moved.withColumn("place", place).join(earlier, ["shard", "part"])
    return slots.select(*kept, "size", "old", "shard", (F.col("place") + F.col("earlier")).cast("bigint").alias("slot"))


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, shard) of a table stored with one folder ``shard=…`` per shard."""
    return spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("shard").cast("int").alias("shard")).distinct()


def reshard_files(spark: SparkSession, files: DataFrame, size: Column, weights: Sequence[float], path: str) -> DataFrame:
    """The files of the new layout, as (file, shard), after moving the fewest bytes.

    ``files`` lists the Parquet files of the old layout. A file whose rows all go to one shard is only
    listed anew; rows of other files are written to new files in ``path``. Nothing is deleted or
    overwritten, so a job that fails leaves the old layout whole.
    """
    held = files.collect()  # a layout's file names, as any scan lists them
    if not held:
        return files
    rows = spark.read.parquet(*[r["file"] for r in held])
    named = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    sized = named.select("__file", "__row", size.alias("__size")).join(files.select(F.col("file").alias("__file"), F.col("shard").alias("__old")), "__file")
    places = written(resharded(sized, F.col("__old"), F.col("__size"), weights).select("__file", "__row", "shard"), "places")
    ends = places.groupBy("__file").agg(F.min("shard").alias("low"), F.max("shard").alias("high"))
    ends = written(ends, "ends")
    split = [r["__file"] for r in ends.where("low < high").collect()]
    whole = ends.where("low = high").select(F.col("__file").alias("file"), F.col("low").alias("shard"))
    if not split:
        return whole
    torn = spark.read.parquet(*split).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    moved = torn.drop("shard").join(places, ["__file", "__row"]).drop("__file", "__row")
    moved.write.partitionBy("shard").parquet(path)
    return whole.unionByName(files_of(spark, path))
