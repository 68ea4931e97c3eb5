"""Stored tables in parts by key: a batch reads and rewrites the parts it touches, and no others.

Appended tables have a folder per range of ids, so new ids mostly touch the last ones. Upserted tables
have a folder per hash of the key. The touched parts of a batch are listed on the driver: at most one
entry per folder of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators.maintenance import upserted
from threadloom.operators.ranking import one_per_key
from threadloom.session import written

#: Ids of one folder of an appended table; folders of an upserted one.
WIDTH, BUCKETS = 1 << 20, 64
#: Neighbouring ids that one task writes.
CHUNK = 1 << 14
PART = "part"


def id_range(key: str, width: int = WIDTH) -> Column:
    return F.floor(F.col(key) / width).cast("bigint")


def bucket(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), buckets).cast("bigint")


def create_parted(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """An empty table with parts at ``path`` unless one is there."""
    empty = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(PART, T.LongType())]))
    empty.write.mode("ignore").partitionBy(PART).parquet(path)


def load_parted(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(PART, T.LongType())])).parquet(path)


def gathered(rows: DataFrame, key: str = "comment_id") -> DataFrame:
    """Rows with a ``part`` placed for writing: neighbouring ids of a part in one task, a large part in many.

    Otherwise every task would open a file in every folder.
    """
    return rows.repartition(PART, id_range(key, CHUNK))


def touched(rows: DataFrame, part: Column) -> list[int]:
    """The parts that ``rows`` fall into."""
    return sorted(r[0] for r in rows.select(part).distinct().collect() if r[0] is not None)


def not_stored(rows: DataFrame, stored: DataFrame, key: str, part: Column) -> DataFrame:
    """Rows of a key that ``stored`` does not hold; only the key column of the touched parts is read."""
    held = stored.where(F.col(PART).isin(touched(rows, part))).select(key)
    return rows.join(held, key, "left_anti")


def append_parted(rows: DataFrame, path: str, schema: T.StructType, key: str = "comment_id", width: int = WIDTH) -> None:
    """Append the rows whose key the table at ``path`` does not hold; repeated keys go in once.

    Rows with a null key are left out. Running it again appends nothing. ``rows`` are read several
    times and should be a stored table.
    """
    names = [f.name for f in schema.fields]
    stored = load_parted(rows.sparkSession, path, schema)
    fresh = not_stored(rows.where(F.col(key).isNotNull()).select(*names), stored, key, id_range(key, width))
    once = one_per_key(fresh, [key], [F.asc(c) for c in names if c != key])
    gathered(once.withColumn(PART, id_range(key, width)), key).write.mode("append").partitionBy(PART).parquet(path)


def upsert_parted(
    rows: DataFrame, path: str, schema: T.StructType, key: str = "parent_id", keep: str = "highest", buckets: int = BUCKETS
) -> None:
    """One row per key out of the stored table and ``rows``, by score; only touched buckets are written anew.

    The new buckets are written to the shared folder first and then take the place of the old ones, so
    nothing reads what it overwrites. Running it again changes nothing. Rows with a null key are left out.
    """
    spark, names = rows.sparkSession, [f.name for f in schema.fields]
    incoming = rows.where(F.col(key).isNotNull()).select(*names)
    stored = load_parted(spark, path, schema).where(F.col(PART).isin(touched(incoming, bucket(key, buckets))))
    merged = written(upserted(stored.select(*names), incoming, key, keep).withColumn(PART, bucket(key, buckets)), "merged")
    merged.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
