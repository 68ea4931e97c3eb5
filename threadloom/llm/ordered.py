"""Stored orders and digests of ordered rows, without bringing a group's rows together in memory."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import evenly
from threadloom.session import written


def in_order(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` sorted over ranges and stored, with its range ``part`` and its place ``idx`` in it.

    Rows of a hot key fill many ranges. The table is written, because ranges drawn anew may differ.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(count, *order).sortWithinPartitions(*order)
    return written(with_place(dealt), name)


def with_place(df: DataFrame) -> DataFrame:
    """``df`` with its partition ``part`` and the place ``idx`` of each row there, from 0."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.select("*", F.spark_partition_id().alias("part"), place.alias("idx"))


def earlier_sum(parts: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """``parts`` with the sum ``name`` of ``value`` over the earlier rows of the same keys.

    ``parts`` holds one row per key and partition of a table, so a window over it stays small.
    """
    ahead = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(name, F.coalesce(F.sum(value).over(ahead), F.lit(0).cast("bigint")))


def digests(df: DataFrame, keys: Sequence[str], order: Sequence[str], piece: str, between: str, name: str) -> DataFrame:
    """(keys, ``name``): SHA-256 in hex of the pieces of each key in order, joined by ``between``.

    Rows stream through the hash in sorted order, so memory does not depend on the size of a group.
    Keys must not be null; a null piece counts as empty.
    """
    schema = T.StructType([*df.select(*keys).schema.fields, T.StructField(name, T.StringType())])
    joint = between.encode()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, state = None, None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip([*keys, name], r)) for r in rows], schema=target)

        target = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if target is None:
                target = pa.schema([*[batch.schema.field(k) for k in keys], pa.field(name, pa.string())])
            columns = [batch.column(i) for i in range(len(keys))]
            pieces, n, done = batch.column(len(keys)), batch.num_rows, []
            fresh = np.zeros(n - 1, bool)
            for c in columns:
                fresh |= np.asarray(pa.compute.not_equal(c[1:], c[:-1]))
            cuts = [0, *(np.flatnonzero(fresh) + 1).tolist(), n]
            for low, high in zip(cuts, cuts[1:]):
                key = tuple(c[low].as_py() for c in columns)
                if key != open_key:
                    if state is not None:
                        done.append((*open_key, state.hexdigest()))
                    open_key, state = key, hashlib.sha256()
                else:
                    state.update(joint)
                for i in range(low, high):
                    if i > low:
                        state.update(joint)
                    state.update((pieces[i].as_py() or "").encode("utf-8", "surrogatepass"))
            if done:
                yield made(done)
        if state is not None:
            yield made([(*open_key, state.hexdigest())])

    dealt = evenly(df, *keys).sortWithinPartitions(*keys, *order).select(*keys, piece)
    return dealt.mapInArrow(run, schema)
