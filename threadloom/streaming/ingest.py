"""Incremental ingest: new dump files into the stored posts table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.session import written
from threadloom.sources.parts import PART, WIDTH, append_parted, create_parted, gathered, id_range, load_parted, touched
from threadloom.sources.tables import POSTS, append_new, create_table


def ingest_posts(
    spark: SparkSession,
    incoming: str,
    table: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    schema: T.StructType = POSTS,
    file_format: str = "parquet",
    files_per_batch: int = 1,
) -> None:
    """Take in every file not seen yet, then stop.

    The checkpoint is the resume point. A batch that fails half-way is run again whole, and the
    keyed append drops what it had already written. No row waits for a batch to fill up.
    """
    create_table(spark, table)
    files = spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", files_per_batch)

    def store(batch: DataFrame, _batch_id: int) -> None:
        append_new(prepare(batch) if prepare else batch, table)

    query = (
        files.load(incoming)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def paired(batch: DataFrame, batch_id: int, table: str, waiting: str, schema: T.StructType, width: int, patience: int | None) -> None:
    """Take one batch of posts in: questions, replies whose question is known, and replies that waited for one.

    Replies to unknown questions go to ``waiting``, a table with folders per batch and range of the
    question's id. Of it only the ranges of new questions are read and, with ``patience``, only that
    many batches before: older replies have been given up. Both tables are only appended to, stored
    keys are skipped, so a batch that is run again does no harm.
    """
    names = [f.name for f in schema.fields]
    held = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    spark = batch.sparkSession
    rows = written(batch.select(*names), "batch")
    questions, replies = rows.where("parent_id is null"), rows.where("parent_id is not null")
    new = questions.where("comment_id is not null").select(F.col("comment_id").alias("parent_id")).distinct()
    stored = load_parted(spark, table, schema).where(F.col(PART).isin(touched(replies, id_range("parent_id", width))))
    known = stored.where("parent_id is null").select(F.col("comment_id").alias("parent_id")).union(new)
    found = written(replies.join(known, "parent_id", "left_semi").select(*names), "found")
    lone = replies.join(known, "parent_id", "left_anti").select(*names)
    since = 0 if patience is None else batch_id - patience
    late = load_parted(spark, waiting, held).where(F.col(PART).isin(touched(new, id_range("parent_id", width))))
    late = late.where((F.col("batch") >= since) & (F.col("batch") < batch_id)).join(new, "parent_id", "left_semi").select(*names)
    lone = lone.withColumn("batch", F.lit(batch_id).cast("bigint")).withColumn(PART, id_range("parent_id", width))
    gathered(lone).write.mode("append").partitionBy("batch", PART).parquet(waiting)
    append_parted(written(questions.unionByName(found).unionByName(late), "paired"), table, schema, width=width)


def ingest_paired_posts(
    spark: SparkSession, incoming: str, table: str, waiting: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None,
    schema: T.StructType = POSTS, file_format: str = "parquet", files_per_batch: int = 64, width: int = WIDTH, patience: int | None = None,
) -> None:
    """Take in every file not seen yet, many at a time, so that ``table`` never holds a reply without its question.

    Posts are stored in folders by range of ids; a batch looks for stored keys in the folders it
    touches only. Replies wait in ``waiting`` until their question comes, or are given up after
    ``patience`` batches. Rows without an id are left out.
    """
    create_parted(spark, table, schema)
    empty = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField(PART, T.LongType())]))
    empty.write.mode("ignore").partitionBy("batch", PART).parquet(waiting)
    files = spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", files_per_batch)

    def store(batch: DataFrame, batch_id: int) -> None:
        paired(prepare(batch) if prepare else batch, batch_id, table, waiting, schema, width, patience)

    query = files.load(incoming).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
