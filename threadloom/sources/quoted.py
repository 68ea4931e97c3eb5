"""Delimited files with line breaks inside quotes, read split by split.

A line starts inside quotes if the quotes before it in its file are odd in number. Quotes are first
counted per split; their running sum tells each split how it begins. A split then puts its own records
together, and only records that cross a border are joined from their parts. No file has to be read by
one task, and no line is shuffled unless its record crosses a border.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WHOLE, _OPENED, _CONTINUED = 0, 1, 2
_PARTS = "path string, start bigint, kind int, header boolean, value string"
_ARROW = pa.schema([
    ("path", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("header", pa.bool_()), ("value", pa.string()),
])


class _Split:
    """The records of one split, fed batch by batch; holds the lines of one unfinished record."""

    def __init__(self, path: str, start: int, inside: bool | None):
        if inside is None:
            raise ValueError(f"{path}: no quotes counted for the split at {start}; the file was cut elsewhere before")
        self.path, self.start, self.inside = path, start, bool(inside)
        self.open: list[str] = []
        self.inherited = self.inside
        self.header = start == 0

    def _row(self, kind: int, lines: list[str]):
        row = (self.path, self.start, kind, self.header, lines[0] if len(lines) == 1 else "\n".join(lines))
        self.header = self.inherited = False
        return row

    def feed(self, lines: list[str], quotes: np.ndarray) -> Iterator[tuple]:
        odd = (np.cumsum(quotes) + self.inside) % 2
        begin = 0
        for end in np.flatnonzero(odd == 0) + 1:
            yield self._row(_CONTINUED if self.inherited else _WHOLE, self.open + lines[begin:end])
            self.open, begin = [], int(end)
        self.open += lines[begin:]
        self.inside = bool(odd[-1])

    def rest(self) -> Iterator[tuple]:
        if self.open:
            yield self._row(_CONTINUED if self.inherited else _OPENED, self.open)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _records_of_splits(quote: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for batch in batches:
            if not batch.num_rows:
                continue
            paths, starts, values = batch.column("path"), batch.column("start").to_numpy(), batch.column("value")
            quotes = pc.count_substring(values, quote).to_numpy()
            numbers = pc.rank(paths, tiebreaker="min").to_numpy()
            changes = np.flatnonzero((np.diff(starts) != 0) | (np.diff(numbers) != 0)) + 1
            borders = [0, *changes.tolist(), batch.num_rows]
            rows = []
            for low, high in zip(borders, borders[1:]):
                key = (paths[low].as_py(), int(starts[low]))
                if split is None or (split.path, split.start) != key:
                    if split is not None:
                        rows += split.rest()
                    split = _Split(*key, batch.column("inside")[low].as_py())
                rows += split.feed(values.slice(low, high - low).to_pylist(), quotes[low:high])
            yield _batch(rows)
        if split is not None:
            yield _batch(list(split.rest()))

    return run


def quoted_records(spark: SparkSession, path: str, encoding: str = "UTF-8", quote: str = '"') -> DataFrame:
    """(value, header): one row per record, its line breaks kept; ``header`` marks the first of each file.

    Quotes inside a quoted field have to be doubled and unquoted fields must hold none, as in files that
    quote what needs it. Empty records are left out. A record that ends with ``\\r\\n`` has its breaks of
    that kind read as ``\\n``; other records keep theirs as they are. A last record whose quotes stay open
    ends with its file. ``encoding`` must spell line break and quote as ASCII does. One row per split is
    broadcast: its path, its start and a flag, some hundred bytes for each
    ``spark.sql.files.maxPartitionBytes``.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    lines = read.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.decode(F.col("value").cast("binary"), encoding).alias("value"),
    )
    odd = (F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))) % 2
    counted = lines.groupBy("path", "start").agg((F.sum(odd) % 2).alias("odd"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begins = counted.select("path", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    parts = lines.join(F.broadcast(begins), ["path", "start"], "left").mapInArrow(_records_of_splits(quote), _PARTS)

    whole = parts.where(F.col("kind") == _WHOLE).select("value", "header")
    crossing = parts.where(F.col("kind") != _WHOLE)
    place = Window.partitionBy("path").orderBy("start", F.desc("kind"))  # a split continues a record before it opens one
    numbered = crossing.withColumn("record", F.sum((F.col("kind") == _OPENED).cast("bigint")).over(place))
    joined = numbered.groupBy("path", "record").agg(
        F.sort_array(F.collect_list(F.struct("start", "header", "value"))).alias("p")
    )
    mended = joined.select(F.array_join(F.col("p.value"), "\n").alias("value"), F.get("p.header", F.lit(0)).alias("header"))
    both = whole.unionByName(mended)
    inner = F.replace(F.substring("value", 1, F.length("value") - 1), F.lit("\r\n"), F.lit("\n"))
    ended = F.when(F.endswith("value", F.lit("\r")), inner).otherwise(F.col("value"))
    return both.select(ended.alias("value"), "header").where(F.col("value") != "")
