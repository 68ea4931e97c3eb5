"""SimHash near-duplicates, linked through a segment-popcount embedding.

A fingerprint is cut into segments; the bit counts of its segments are a point whose Manhattan
distance to another point never exceeds the Hamming distance. Two points at distance 2 or less share
a grid cell at distance 1 or less from both, so every fingerprint is entered in its own cell and the
cells one step away along each axis, and a plain equality join finds all candidates. Which steps a
pair may have taken is fixed, so that each pair meets in one cell only; the bits are then compared
exactly. Equal fingerprints are one node before the join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import mapped
from threadloom.llm.components import smallest_reachable
from threadloom.session import written

SEED = 42


#: Bytes of a text whose words and shingles are held at once.
SLICE = 1 << 18


def _words(data: bytes, low: int, high: int) -> list[bytes]:
    """The words of ``data`` that start from ``low`` to before ``high``; the last may end behind it."""
    if low and not data[low - 1 : low].isspace():  # the word before ``low`` goes on
        while low < min(high, len(data)) and not data[low : low + 1].isspace():
            low += 1
        if low == high:
            return []
    while high < len(data) and not data[high - 1 : high].isspace() and not data[high : high + 1].isspace():
        high += 1
    return data[low:high].split()


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of ``text`` (ASCII lower-cased, ASCII white space).

    A bit is set if more than half of the shingles' XXH64 values have it, repeats counted. Fewer
    words than ``shingle`` make one shingle; null, empty and blank texts give 0.
    """
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    digest, ones, count, kept = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for low in range(0, len(data), SLICE):
        words = _words(data, low, low + SLICE)
        known, kept = len(kept), kept + words
        if not words:
            continue
        grams = [b" ".join(kept[i : i + shingle]) for i in range(max(0, known - shingle + 1), len(kept) - shingle + 1)]
        hashes = np.fromiter([digest(g, SEED) for g in grams], np.uint64, len(grams))
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        count += len(grams)
        kept = kept[-shingle:] if count else kept
    if not count:
        return digest(b" ".join(kept), SEED) if kept else 0
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) with the fingerprint as a signed long; one row per input row."""

    def make() -> Callable:
        def work(keys: list, hashes: list, texts: list) -> Iterator[tuple]:
            yield keys, hashes, np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)

        return work

    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return mapped(source, ["doc_id", "text_hash", "text"], [("doc_id", "long"), ("text_hash", "long"), ("fp", "long")], make)


def links(distinct: DataFrame, bits: int = 2, segments: int = 16) -> DataFrame:
    """Pairs (a, b) of different fingerprints in column ``fp`` that differ in at most ``bits`` (2) bits.

    Each pair comes once. With d = point(b) - point(a): equal points meet in their own cell; d = +e_i
    in the cell a + e_i = b; d = e_i + e_j (i <= j) in a + e_i = b - e_j; d = e_i - e_j in
    a + e_i = b + e_j. No other difference is possible at distance 2.

    Spark sizes an exploded table as if it had not been exploded, so it would send 33 rows of every
    fingerprint through the driver while the plain table is small: both sides are sorted instead.
    """
    if not 0 <= bits <= 2:
        raise ValueError("cells one step away prove distances up to 2")
    width = 64 // segments
    base = width + 3  # counts of 0 to width, one step either way
    if 64 % segments or base**segments >= 1 << 63:
        raise ValueError("segments must divide 64 and number at most 16")
    counts = F.array(
        *[F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1))).cast("bigint") for i in range(segments)]
    )
    powers = [base**i for i in range(segments)]
    cell: Column = F.lit(sum(powers)).cast("bigint")
    for i, p in enumerate(powers):
        cell = cell + F.col("counts")[i] * F.lit(p).cast("bigint")
    steps = F.array(
        *[
            F.struct(F.lit(step).cast("byte").alias("step"), F.lit(by).cast("bigint").alias("by"))
            for step, by in [(0, 0), *[(i + 1, p) for i, p in enumerate(powers)], *[(-i - 1, -p) for i, p in enumerate(powers)]]
        ]
    )
    points = distinct.select("fp", counts.alias("counts")).select("fp", cell.alias("cell"))
    entered = points.select("fp", "cell", F.explode(steps).alias("s")).select(
        "fp", (F.col("cell") + F.col("s.by")).alias("cell"), F.col("s.step").alias("step")
    )
    a, b = entered.alias("a"), entered.alias("b")
    sa, sb = F.col("a.step"), F.col("b.step")
    once = (
        ((sa == 0) & (sb == 0) & (F.col("a.fp") < F.col("b.fp")))
        | ((sa > 0) & (sb == 0))
        | ((sa > 0) & (sb < 0) & (sa <= -sb))
        | ((sa > 0) & (sb > 0) & (sa < sb))
    )
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= bits
    return (
        a.where(F.col("a.step") >= 0).hint("merge")
        .join(b.hint("merge"), (F.col("a.cell") == F.col("b.cell")) & close & once)
        .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    )


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, bits: int = 2, segments: int = 16
) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) per input row: the smallest id reachable over links.

    ``root`` is the smallest fingerprint of the component. Repeated rows are answered each.

    Documents without words have fingerprint 0 and link like any other. Rows that repeat an id or a
    text belong to the same component through their fingerprint. A row with a null id takes part and
    gets the component's smallest id, null only if all of its ids are null. Empty tables give no rows.
    """
    marked = written(fingerprints(docs, text, key, shingle), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    pairs = written(links(nodes.select("fp"), bits, segments), "links")
    members = smallest_reachable(pairs)  # (node, root) of linked fingerprints only
    linked = members.join(nodes, members["node"] == nodes["fp"]).select("node", "root", "first")
    smallest = linked.groupBy("root").agg(F.min("first").alias("smallest"))
    found = linked.join(smallest, "root").select(F.col("node").alias("fp"), "root", "smallest")
    named = nodes.join(found, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("smallest", "first").alias("component_id")
    )
    return marked.join(written(named, "components"), "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, bits: int = 2) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest id.

    A null id counts as the largest; of repeated rows one stays, and of different texts under the
    smallest id the one with the smallest hash.
    """
    found = near_duplicates(docs, text, key, shingle, bits)
    best = found.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("n"), "doc_id", "text_hash")).alias("b"))
    kept = best.select(F.col("b.doc_id").alias("__id"), F.col("b.text_hash").alias("__hash"))
    hashed = docs.withColumn("__key", F.col(key).cast("bigint")).withColumn("__text_hash", F.xxhash64(text))
    same = F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash"))
    return hashed.join(kept, same, "left_semi").dropDuplicates(["__key", "__text_hash"]).select(docs.columns)
