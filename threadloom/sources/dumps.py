"""XML dumps: one ``<row …/>`` element per record, all fields as attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _rows(spark: SparkSession, path: str, attributes: str, one_per_line: bool) -> DataFrame:
    """Attributes as text, so that one malformed number does not spoil its whole row.

    Dumps put each ``<row …/>`` on its own line; read as lines, a single huge file splits over many
    tasks. A pretty-printed file needs ``one_per_line=False``, which reads a file per task.
    """
    schema = T.StructType([T.StructField(f"_{a}", T.StringType()) for a in attributes.split()])
    options = {"rowTag": "row", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"}
    if not one_per_line:
        return spark.read.format("xml").options(**options).schema(schema).load(path)
    lines = spark.read.text(path).where(F.ltrim("value").startswith("<row"))
    return lines.select(F.from_xml("value", schema, options).alias("row")).select("row.*")


def _number(attribute: str) -> Column:
    return F.col(f"_{attribute}").try_cast("bigint")


def posts_dump(spark: SparkSession, path: str, one_per_line: bool = True) -> DataFrame:
    """Raw posts; a row without a whole-number Id and Score, a creation date and a body is skipped."""
    rows = _rows(
        spark, path, "Id PostTypeId ParentId Score CreationDate Body Title Tags AcceptedAnswerId", one_per_line
    )
    return rows.select(
        _number("Id").alias("id"),
        _number("PostTypeId").alias("post_type_id"),
        _number("ParentId").alias("parent_id"),
        _number("Score").alias("score"),
        F.substring_index("_CreationDate", "T", 1).try_cast("date").alias("date"),
        F.col("_Body").alias("body"),
        F.col("_Title").alias("title"),
        F.col("_Tags").alias("tags"),
        _number("AcceptedAnswerId").alias("accepted_answer_id"),
    ).where("id is not null and score is not null and date is not null and body is not null")


def links_dump(spark: SparkSession, path: str, one_per_line: bool = True) -> DataFrame:
    """Post links; ids that are empty or no number are null."""
    return _rows(spark, path, "PostId RelatedPostId LinkTypeId", one_per_line).select(
        _number("PostId").alias("post_id"),
        _number("RelatedPostId").alias("related_post_id"),
        _number("LinkTypeId").alias("link_type_id"),
    )


def tags_dump(spark: SparkSession, path: str, one_per_line: bool = True) -> DataFrame:
    """(id, tag_name), one row per id; of repeated ids the greatest name is kept.

    Files are read in parallel, so "the last one in the file" has no meaning here.
    """
    rows = _rows(spark, path, "Id TagName", one_per_line).where(F.col("_TagName").isNotNull() & F.col("_Id").isNotNull())
    return rows.groupBy(_number("Id").alias("id")).agg(F.max("_TagName").alias("tag_name"))


def comments_dump(spark: SparkSession, path: str, one_per_line: bool = True) -> DataFrame:
    return _rows(spark, path, "Id PostId Score Text", one_per_line).select(
        _number("Id").alias("id"), _number("PostId").alias("post_id"), _number("Score").alias("score"),
        F.col("_Text").alias("text"),
    )
