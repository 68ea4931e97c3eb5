"""Groupings, argmax, counts and histograms.

Lists are kept in long form, one row per member with its position, so nothing grows with a key; only
the rows that are shown or written as a line gather them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import scored_answer
from threadloom.operators.ranking import best_per_key

ID_SPAN = 65536


def joined_tags(tags: DataFrame) -> DataFrame:
    """One blank-joined tag string per Id, tags in ascending order.

    Equal tags of an Id are counted before they meet, so a list holds each distinct tag once until
    it is spelled out.
    """
    counted = tags.groupBy("Id", "Tag").agg(F.count(F.lit(1)).cast("int").alias("times"))
    listed = counted.groupBy("Id").agg(F.sort_array(F.collect_list(F.struct("Tag", "times"))).alias("tags"))
    spelled = F.flatten(F.transform("tags", lambda t: F.array_repeat(t["Tag"], t["times"])))
    return listed.select("Id", F.array_join(spelled, " ").alias("Tag"))


def id_positions(pairs: DataFrame, key: str, member: str, name: str) -> DataFrame:
    """(key, position, id): the members of each key in ascending order, from 1, repeats kept.

    Positions are counted in two steps: a member's place within its range of ids, plus the sizes of
    the earlier ranges of its key. A hot key spreads over its ranges, whose sizes combine on the map
    side, and nothing is cut.
    """
    known = pairs.where(F.col(key).isNotNull() & F.col(member).isNotNull())
    ranged = known.select(key, F.col(member).alias(name), F.floor(F.col(member) / ID_SPAN).alias("_range"))
    sizes = ranged.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(key, "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(key, "_range").orderBy(name))
    placed = ranged.withColumn("_place", place).join(before, [key, "_range"])
    return placed.select(key, (F.col("_place") + F.col("_before")).alias("position"), name)


def parent_answer_lists(posts: DataFrame) -> DataFrame:
    """Answer ids of each parent, in order."""
    return id_positions(posts, "parent_id", "comment_id", "answer_id")


def duplicate_lists(pairs: DataFrame) -> DataFrame:
    """Newer duplicates of each post, in order."""
    return id_positions(pairs, "related_post_id", "post_id", "post_id")


def combined_answers(parents: DataFrame, answers: DataFrame) -> DataFrame:
    """Found parents with all their answers as ``comment::score`` texts, best score first.

    One row per found parent. Each parent's answers are gathered once, however many questions found
    it, and only those of found parents; titles, bodies and distances are joined to them afterwards.
    Parents with a missing shown value, or without an answer that has a text, are left out.
    """
    for column in ("comment_id", "comment", "title", "score", "distances", "tags"):
        parents = parents.where(F.col(column).isNotNull())
    wanted = parents.select(F.col("comment_id").alias("parent_id")).distinct()
    replies = answers.where(F.col("comment").isNotNull()).join(wanted, "parent_id", "left_semi")
    entry = F.struct(
        F.isnull("score").alias("none"), (-F.col("score")).alias("order"), "comment_id",
        scored_answer(F.col("comment"), F.col("score")).alias("text"),
    )
    lists = replies.groupBy("parent_id").agg(F.sort_array(F.collect_list(entry)).alias("_texts"))
    shown = parents.drop("parent_id", "date").withColumnsRenamed({"comment": "comment_parent", "score": "score_parent"})
    found = shown.join(lists, F.col("comment_id") == F.col("parent_id"))
    return found.withColumn("combined_comments", F.col("_texts")["text"]).drop("_texts")


def best_answer(found: DataFrame, *keys: str) -> DataFrame:
    """Highest-scoring answer row per parent, the lower answer id on ties.

    Only scores and ids are grouped; bodies are joined with the chosen ids.
    """
    return best_per_key(found, [*keys, "parent_id"], "score_comment", "answer_id")


def column_maxima(df: DataFrame, key: str = "parent_id") -> DataFrame:
    """Maximum of every column on its own per key; values of one row may come from several."""
    return df.groupBy(key).agg(*[F.max(c).alias(c) for c in df.columns if c != key])


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Frequency of each value, most common first, ties by value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    ordered = counts.orderBy(F.desc("count"), F.asc(column))
    return ordered.limit(top) if top else ordered


def mean_vector(df: DataFrame, column: str, dim: int) -> DataFrame:
    """Elementwise mean of a vector column as one row."""
    means = ", ".join(f"avg(get({column}, {i}))" for i in range(dim))
    return df.agg(F.expr(f"array({means})").alias("mean"))


def token_vocabulary(
    tokens: DataFrame, max_vocab: int = 60000, min_freq: int = 2, specials: Sequence[str] = ()
) -> DataFrame:
    """The ``max_vocab`` most frequent tokens seen more than ``min_freq`` times, numbered.

    Specials take the first numbers. Ties go by token. Only the ``max_vocab`` winners reach the
    numbering window.
    """
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    order = [F.desc("count"), F.asc("token")]
    kept = counts.orderBy(*order).limit(max_vocab).where(F.col("count") > min_freq)
    numbered = kept.select(
        "token", "count", (F.row_number().over(Window.orderBy(*order)) + len(specials) - 1).cast("int").alias("idx")
    )
    if not specials:
        return numbered
    fixed = tokens.sparkSession.createDataFrame(
        [(word, 0, i) for i, word in enumerate(specials)], "token string, count bigint, idx int"
    )
    return fixed.unionByName(numbered)


def length_histogram(values: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts in ``bins`` equal-width bins from minimum to maximum, the last one closed."""
    span = values.agg(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high"))
    bounds = span.select("low", ((F.col("high") - F.col("low")) / bins).alias("width"))
    slot = F.when(F.col("width") == 0, F.lit(bins // 2)).otherwise(
        F.least(F.floor((F.col(column) - F.col("low")) / F.col("width")), F.lit(bins - 1))
    )
    bounded = values.crossJoin(F.broadcast(bounds))  # one row of two numbers
    counted = bounded.groupBy(slot.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    every = values.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(counted, "bin", "left").select("bin", F.coalesce("rows", F.lit(0)).alias("rows"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def min_max_scaled(df: DataFrame, columns: Sequence[str], *keys: str) -> DataFrame:
    """Columns scaled to 0..1 within each key; a constant column becomes 0.

    The bounds are aggregated and joined back: a window over a hot key would hold all its rows.
    """
    bounds = df.groupBy(*keys).agg(
        *[F.min(c).alias(f"_low_{c}") for c in columns], *[F.max(c).alias(f"_high_{c}") for c in columns]
    )
    joined = df.join(bounds, [*keys])
    for c in columns:
        width = F.col(f"_high_{c}") - F.col(f"_low_{c}")
        joined = joined.withColumn(c, F.when(width == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"_low_{c}")) / width))
    return joined.select(*df.columns)
