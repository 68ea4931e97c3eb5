"""Joins between questions, answers, tags, links and distances.

No side is marked for broadcast here: Spark's own size check decides, and adaptive execution splits
hot keys of a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_tags(questions: DataFrame, joined_tags: DataFrame) -> DataFrame:
    """Left join of questions and their tag string; one tag row per Id keeps the row count."""
    return questions.join(joined_tags, "Id", "left")


def with_distances(parents: DataFrame, neighbours: DataFrame, *keys: str) -> DataFrame:
    """Left join of found parents and their distance.

    A post found under several tags has one distance to a question; the smallest is taken, which
    also keeps the row count of ``parents``.
    """
    on = [*keys, "comment_id"]
    nearest = neighbours.groupBy(*on).agg(F.min("distances").alias("distances"))
    return parents.join(nearest, on, "left")


def parents_with_answers(parents: DataFrame, answers: DataFrame) -> DataFrame:
    """Parents with each of their answers that has a text.

    Dropping null answers after a left join leaves exactly the inner join with non-null bodies.
    """
    replies = answers.where(F.col("comment").isNotNull()).select(
        F.col("comment_id").alias("answer_id"),
        "parent_id",
        F.col("comment").alias("comment_comment"),
        F.col("score").alias("score_comment"),
    )
    found = parents.withColumnsRenamed({"comment": "comment_parent", "score": "score_parent"})
    found = found.drop("parent_id", "date")
    return found.join(replies, F.col("comment_id") == F.col("parent_id"))


def answer_ids_of(neighbours: DataFrame, posts: DataFrame, *keys: str) -> DataFrame:
    """Ids of the answers to the found posts; posts without answers vanish."""
    pairs = posts.where(F.col("parent_id").isNotNull()).select(
        F.col("parent_id"), F.col("comment_id").alias("answer_id")
    )
    wanted = neighbours.select(*keys, F.col("comment_id").alias("parent_id")).distinct()
    return wanted.join(pairs, "parent_id").select(*keys, "parent_id", "answer_id")


def with_parent_fields(posts: DataFrame) -> DataFrame:
    """Answers with body, title and tags of their parent (null where the parent is not stored)."""
    parents = posts.select(
        F.col("comment_id").alias("parent_id"),
        F.col("comment").alias("parent"),
        F.col("title").alias("parent_title"),
        F.col("tags").alias("parent_tags"),
    )
    answers = posts.where(F.col("parent_id").isNotNull())
    return answers.join(parents, "parent_id", "left").select(
        "comment_id",
        "parent_id",
        "parent",
        "comment",
        F.col("parent_title").alias("title"),
        F.col("date").alias("unix"),
        "score",
        F.col("parent_tags").alias("tags"),
    )


def parent_reply(posts: DataFrame) -> DataFrame:
    """The denormalised reply table: answers with a stored parent take its fields, all else stays."""
    fields = ["comment_id", "parent_id", "parent", "comment", "title", "unix", "score", "tags"]
    own = posts.select(
        "comment_id", "parent_id", F.lit(None).cast("string").alias("parent"), "comment", "title",
        F.col("date").alias("unix"), "score", "tags",
    )
    answers = with_parent_fields(posts).select(fields)
    return own.where(F.col("parent_id").isNull()).select(fields).unionByName(answers)


def with_parent_text(pairs: DataFrame, posts: DataFrame) -> DataFrame:
    """Training pairs whose title is the parent's body; null where the parent is missing."""
    bodies = posts.select(F.col("comment_id").alias("parent_id"), F.col("comment").alias("title"))
    return pairs.join(bodies, "parent_id", "left")


def duplicate_pairs(links: DataFrame, posts: DataFrame) -> DataFrame:
    """Links of the duplicate type, newer post first, both ends stored."""
    ids = posts.select("comment_id")
    kept = links.where(
        (F.col("link_type_id") == 3)
        & F.col("post_id").isNotNull()
        & F.col("related_post_id").isNotNull()
        & (F.col("post_id") > F.col("related_post_id"))
    ).select("post_id", "related_post_id")
    kept = kept.join(ids.withColumnRenamed("comment_id", "related_post_id"), "related_post_id", "left_semi")
    return kept.join(ids.withColumnRenamed("comment_id", "post_id"), "post_id", "left_semi")


def missing_questions(csv_questions: DataFrame, posts: DataFrame) -> DataFrame:
    """Question rows whose id is not stored yet."""
    stored = posts.select(F.col("comment_id").alias("Id"))
    return csv_questions.join(stored, "Id", "left_anti")


def answers_of(csv_answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answer rows whose question is among ``questions``."""
    ids = questions.select(F.col("Id").alias("ParentId"))
    return csv_answers.join(ids, "ParentId", "left_semi")


def answers_to_kept(posts: DataFrame, kept: DataFrame) -> DataFrame:
    """Answers whose parent was kept, in whatever order rows arrive."""
    ids = kept.select(F.col("comment_id").alias("parent_id"))
    return posts.join(ids, "parent_id", "left_semi")


def tokens_with_vectors(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Tokens that have a word vector, with it."""
    return tokens.join(words, "word")


def tokens_with_idf(tokens: DataFrame, idf: DataFrame, default: float = 0.0) -> DataFrame:
    """Tokens with their idf, ``default`` where unknown."""
    known = idf.select(F.col("term").alias("word"), "idf")
    return tokens.join(known, "word", "left").withColumn("idf", F.coalesce("idf", F.lit(default)))


def candidates_of_tags(questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Thread vectors of the tags each question asks for; tag folders nobody asks for stay unread."""
    return questions.join(vectors, "tag")
