"""Ranks that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import written


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key.

    Spark cuts each partition to ``k`` rows per key before the shuffle (window group limit), so a
    hot key sends at most ``k`` rows per task.
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, position).where(F.col(rank) <= k)


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first by ``order``.

    Only rows of keys that repeat are sorted; all others are passed on as they are. ``df`` is read twice.
    """
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    left, right = df.alias("l"), repeated.alias("r")
    single = left.join(right, same, "left_anti").select("l.*")
    chosen = top_k(left.join(right, same, "left_semi").select("l.*"), keys, order, 1, "_rank").drop("_rank")
    return single.unionByName(chosen)


def towards_of(score: str, highest: bool) -> Column:
    """The score so that the best one is the least."""
    return -F.col(score) if highest else F.col(score)


def best_per_key(df: DataFrame, keys: Sequence[str], score: str, item: str, highest: bool = True) -> DataFrame:
    """One row per key: the best score, the lower item on ties, null scores last.

    Score and item of the best are found on their own columns, combined before the shuffle; whole rows
    are only joined with them.
    """
    best = df.groupBy(*keys).agg(F.min(F.struct(F.isnull(score).alias("none"), towards_of(score, highest).alias("towards"), F.col(item).alias("item"))).alias("_b"))
    left, right = df.alias("l"), best.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    same += [F.col(f"l.{item}").eqNullSafe(F.col("r._b.item")), towards_of(f"l.{score}", highest).eqNullSafe(F.col("r._b.towards"))]
    rest = [F.asc(c) for c in df.columns if c not in keys]
    return one_per_key(left.join(right, same, "left_semi").select("l.*"), keys, rest)


def full_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Position of every row within its key, without bringing a key into one task.

    Rows are range-partitioned by key and order, so a hot key spreads over many partitions; a row's
    rank is its place in its own partition plus the rows of its key in earlier ones. The ranged rows
    are written once, because a recomputed range partitioning may cut elsewhere. ``order`` must
    leave no ties.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    ranged = written(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    per_part = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(*keys, "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    ranks = ranged.withColumn("_place", place).join(offsets, [*keys, "_part"])
    return ranks.withColumn(rank, F.col("_place") + F.col("_before")).drop("_part", "_place", "_before")


def ranked_candidates(scored: DataFrame, key: str = "qid") -> DataFrame:
    """Candidates by score, the earlier one first on equal scores; ranks start at 1."""
    return full_rank(scored, [key], [F.desc("score"), F.asc("pos")])


def rank_of_first(scored: DataFrame, key: str = "qid") -> DataFrame:
    """Rank of candidate 0 per question.

    Counting the candidates ahead of it needs no sort: each task sums its own rows first. On equal
    scores candidate 0 leads, so only strictly better ones count.
    """
    true = scored.where(F.col("pos") == 0).select(key, F.col("score").alias("_true"))
    ahead = F.sum((F.col("score") > F.col("_true")).cast("bigint"))
    return scored.join(true, key).groupBy(key).agg((ahead + 1).alias("rank"))


def confident_tags(probabilities: Column, k: int = 3, cutoff: float = 0.8) -> Column:
    """The ``k`` most probable (tag, score), or only the best if it is above ``cutoff``.

    ``probabilities`` is an array of (score, index, tag); equal scores put the higher class index
    first.
    """
    best = F.slice(F.sort_array(probabilities, asc=False), 1, k)
    kept = F.when(F.get(best, F.lit(0))["score"] > cutoff, F.slice(best, 1, 1)).otherwise(best)
    return F.transform(kept, lambda p: F.struct(p["tag"].alias("tag"), p["score"].alias("score")))


def by_distance(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys, F.asc("distances"), F.asc("comment_id"))


def weight_rank(df: DataFrame, key: str = "qid", rank: str = "rank") -> DataFrame:
    """Place of each candidate by final weight, from 1; a question has at most k per asked tag."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("final_weight"), F.asc("comment_id")))
    return df.withColumn(rank, place)
