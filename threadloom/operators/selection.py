"""Filters and projections over ``posts`` and its relatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import constants as C
from threadloom.functions.text import space_tokens

RESULT_COLUMNS = ("title", "comment_parent", "distances", "tags", "combined_comments")


def positive_score(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("score") > 0)


def questions_only(posts: DataFrame) -> DataFrame:
    """Posts without a parent; they carry title and tags."""
    return posts.where(F.col("parent_id").isNull()).drop("parent_id")


def answers_only(posts: DataFrame) -> DataFrame:
    """Posts with a parent; they carry neither title nor tags."""
    return posts.where(F.col("parent_id").isNotNull()).drop("title", "tags")


def acceptable_long(body: Column, words: int = 250, chars: int = 10000) -> Column:
    """Bodies of 1 to ``chars`` characters with at most ``words`` blank-separated pieces."""
    return (F.size(F.split(body, " ")) <= words) & F.length(body).between(1, chars)


def acceptable_short(body: Column, words: int = 150, chars: int = 1000) -> Column:
    """As :func:`acceptable_long`, by whitespace words and without code blocks."""
    return (
        ~F.contains(body, F.lit("<code>"))
        & (F.size(space_tokens(body)) <= words)
        & F.length(body).between(1, chars)
    )


def without_literal(df: DataFrame, column: str, literal: str = "code") -> DataFrame:
    """Rows whose text does not hold ``literal``; a missing text is not kept."""
    return df.where(~F.contains(F.col(column), F.lit(literal)))


def usable_pairs(pairs: DataFrame, title_over: int = 20, comment_over: int = 100) -> DataFrame:
    """Training pairs with both texts longer than their thresholds (so neither null nor empty)."""
    return pairs.where((F.length("comment") > comment_over) & (F.length("title") > title_over))


def high_scoring_questions(posts: DataFrame, above: int = 500, rows: int = 10) -> DataFrame:
    """The first ``rows`` questions scoring above a threshold, in id order."""
    kept = posts.where(F.col("parent_id").isNull() & (F.col("score") > above))
    return kept.orderBy("comment_id").limit(rows)


def lookup(posts: DataFrame, comment_id: int, *columns: str) -> DataFrame:
    """Columns of one post; the id filter reaches the scan."""
    return posts.where(F.col("comment_id") == comment_id).select(*columns)


def posts_with_ids(posts: DataFrame, ids: DataFrame, id_col: str = "comment_id") -> DataFrame:
    """Posts whose id occurs in ``ids``, once each however often it is repeated there."""
    wanted = ids.select(F.col(id_col).alias("comment_id"))
    return posts.join(wanted, "comment_id", "left_semi")


def existing(rows: DataFrame, posts: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is the id of a stored post."""
    return rows.join(posts.select(F.col("comment_id").alias(column)), column, "left_semi")


def tagged_with_any(posts: DataFrame, tags: Sequence[str] = C.TOPIC_TAGS) -> DataFrame:
    """Posts with at least one of ``tags`` among the whitespace tokens of their tags."""
    listed = F.array(*[F.lit(t) for t in tags])
    return posts.where(F.arrays_overlap(space_tokens(F.col("tags")), listed))


def csv_questions_as_posts(questions: DataFrame) -> DataFrame:
    """Question rows of the CSV dump under the names of ``posts``, parent null."""
    return questions.select(
        F.col("Id").alias("comment_id"),
        F.lit(None).cast("bigint").alias("parent_id"),
        F.col("Body").alias("comment"),
        F.col("Title").alias("title"),
        F.col("Score").alias("score"),
        F.col("Tag").alias("tags"),
    )


def csv_answers_as_posts(answers: DataFrame) -> DataFrame:
    return answers.select(
        F.col("Id").alias("comment_id"),
        F.col("ParentId").alias("parent_id"),
        F.col("Body").alias("comment"),
        F.col("Score").alias("score"),
    )


def complete_replies(replies: DataFrame) -> DataFrame:
    """Replies whose parent text and own text are both present."""
    return replies.where(F.col("parent").isNotNull() & F.col("comment").isNotNull())


def distinct_parents(replies: DataFrame) -> DataFrame:
    """How many different parents the complete replies have."""
    return complete_replies(replies).agg(F.countDistinct("parent_id").alias("parents"))


def askable(questions: DataFrame, column: str = "question") -> DataFrame:
    """Questions that are not blank."""
    return questions.where(F.length(F.trim(F.col(column))) >= 1)


def result_page(ranked: DataFrame, *keys: str) -> DataFrame:
    """The shown columns, distance rounded to two decimals."""
    shown = [F.round("distances", 2).alias(c) if c == "distances" else F.col(c) for c in RESULT_COLUMNS]
    return ranked.select(*keys, *shown)
