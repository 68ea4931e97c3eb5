"""Set operations and table upkeep, as whole-table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.ranking import best_per_key, one_per_key


def all_posts(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions and answers in one table, missing columns null."""
    return questions.unionByName(answers, allowMissingColumns=True)


def ids_not_stored(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct incoming ids that are not stored."""
    return incoming.select("comment_id").subtract(stored.select("comment_id"))


def only_new(incoming: DataFrame, stored: DataFrame, key: str = "comment_id") -> DataFrame:
    """Incoming rows with a key not stored yet; of rows sharing a key one is kept.

    The kept one is the smallest by all its columns: arrival order does not exist in a distributed
    table. Only rows of repeated keys are sorted.
    """
    fresh = incoming.join(stored.select(key), key, "left_anti").select(*incoming.columns)
    return one_per_key(fresh, [key], [F.asc(c) for c in fresh.columns if c != key])


def appended(stored: DataFrame, incoming: DataFrame, key: str = "comment_id") -> DataFrame:
    """The stored table plus the rows that are new to it."""
    return stored.unionByName(only_new(incoming, stored, key), allowMissingColumns=True)


def upserted(stored: DataFrame, incoming: DataFrame, key: str = "parent_id", keep: str = "highest") -> DataFrame:
    """One row per key out of both tables, by score.

    ``keep='lowest'`` is the literal rule of the original update, which replaced a stored answer
    when its score was higher than the new one; ``highest`` is what it was meant to do. Ties keep
    the lower comment id. Only scores and ids are grouped; whole rows are joined with the chosen ones.
    """
    both = stored.unionByName(incoming)
    return best_per_key(both, [key], "score", "comment_id", keep == "highest").select(*both.columns)


def without_orphans(replies: DataFrame) -> DataFrame:
    """Replies whose parent text is known."""
    return replies.where(F.col("parent").isNotNull())


def column_of(df: DataFrame, column: str) -> DataFrame:
    return df.select(column)
