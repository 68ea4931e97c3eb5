"""Parquet tables: scans, keyed appends, vectors by tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators.maintenance import only_new

POSTS = T.StructType([
    T.StructField("comment_id", T.LongType()),
    T.StructField("parent_id", T.LongType()),
    T.StructField("comment", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("score", T.LongType()),
    T.StructField("tags", T.StringType()),
])


def scan(spark: SparkSession, path: str, *columns: str, where: Column | None = None) -> DataFrame:
    """Chosen columns of matching rows; both reach the Parquet reader."""
    table = spark.read.parquet(path)
    if where is not None:
        table = table.where(where)
    return table.select(*columns) if columns else table


def balanced(df: DataFrame) -> DataFrame:
    """Spread a table that is read in fewer splits than there are cores, such as one small file.

    A table with enough splits stays as it is, so nothing large is shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def create_table(spark: SparkSession, path: str, schema: T.StructType = POSTS) -> None:
    """An empty table at ``path`` unless one is there."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def append_new(rows: DataFrame, path: str, key: str = "comment_id") -> None:
    """Append the rows whose key the table does not hold; repeated keys go in once.

    Only the key column of the table is read. Running it again appends nothing, so a retried batch
    does no harm.
    """
    stored = rows.sparkSession.read.parquet(path)
    only_new(rows.select(*stored.columns), stored, key).write.mode("append").parquet(path)


def save_vectors(vectors: DataFrame, path: str) -> None:
    """(tag, comment_id, vec) with one folder per tag.

    Rows of a tag are spread over files by id, so a hot tag is written by many tasks.
    """
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = vectors.repartition(parts, "tag", F.pmod(F.xxhash64("comment_id"), F.lit(16)))
    spread.write.partitionBy("tag").option("maxRecordsPerFile", 1_000_000).parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([
        T.StructField("comment_id", T.LongType()),
        T.StructField("vec", T.ArrayType(T.DoubleType())),
        T.StructField("tag", T.StringType()),
    ])
    return spark.read.schema(schema).parquet(path)
