"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Result types: the Spark type beside its Arrow type.
KINDS = {
    "string": (T.StringType(), pa.string()),
    "long": (T.LongType(), pa.int64()),
    "int": (T.IntegerType(), pa.int32()),
    "double": (T.DoubleType(), pa.float64()),
    "binary": (T.BinaryType(), pa.binary()),
    "longs": (T.ArrayType(T.LongType()), pa.list_(pa.int64())),
    "ints": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "doubles": (T.ArrayType(T.DoubleType()), pa.list_(pa.float64())),
}
Fields = Sequence[tuple[str, str]]


def arrow_schema(fields: Fields) -> pa.Schema:
    return pa.schema([(name, KINDS[kind][1]) for name, kind in fields])


def spark_schema(fields: Fields) -> T.StructType:
    return T.StructType([T.StructField(name, KINDS[kind][0]) for name, kind in fields])


#: Rows per Arrow batch: texts are long, and two tasks share an executor's memory.
BATCH_ROWS = 2000


def _small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session's Arrow batches are made smaller unless the user has chosen a size."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))
    return df


def _array(values: Sequence | pa.Array, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def with_computed(
    df: DataFrame, inputs: Sequence[str], fields: Fields, make: Callable[[], Callable[..., Sequence[Sequence]]]
) -> DataFrame:
    """``df`` with the columns ``fields``, computed per Arrow batch from the columns ``inputs``.

    ``make`` runs once per task and returns the function from input lists to one list per field.
    Every column of ``df`` stays; one that is named like a new column is replaced by it, unless it
    is also an input, which is read first.
    """
    names = [name for name, _ in fields]
    kept = [c for c in df.columns if c not in names]
    extra = [c for c in inputs if c not in kept]
    source = df.select(*kept, *[F.col(c).alias(f"__in_{c}") for c in extra])
    where = {c: kept.index(c) if c in kept else len(kept) + extra.index(c) for c in inputs}
    schema = T.StructType([*df.select(*kept).schema.fields, *spark_schema(fields).fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            found = work(*[batch.column(where[c]).to_pylist() for c in inputs])
            made = [_array(values, KINDS[kind][1]) for values, (_, kind) in zip(found, fields)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(kept))], *made], names=[*kept, *names]
            )

    return _small_batches(source).mapInArrow(run, schema)


def mapped(
    df: DataFrame, inputs: Sequence[str], fields: Fields, make: Callable[[], Callable[..., Iterable[Sequence[Sequence]]]]
) -> DataFrame:
    """Rows of ``fields`` from the columns ``inputs``; a batch may give any number of rows.

    The function ``make()`` returns yields groups of rows as one list per field, so a large batch
    need not be answered at once.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, schema = make(), arrow_schema(fields)
        for batch in batches:
            for found in work(*[batch.column(i).to_pylist() for i in range(len(inputs))]):
                yield pa.RecordBatch.from_arrays(
                    [_array(values, f.type) for values, f in zip(found, schema)], schema=schema
                )

    return _small_batches(df).select(*inputs).mapInArrow(run, spark_schema(fields))


def by_size(sizes: Sequence[int], most: int) -> Iterator[slice]:
    """Slices of neighbouring entries of about ``most`` in sum; an entry above it stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % modulus


def evenly(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key over all shuffle partitions, whatever their size in bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
