"""A stored index of vectors: cells per group, written once, searched by any later session.

Building splits every group by trained centres until a cell holds about ``ROWS`` vectors. A cell is one
row: its ids, its vectors as a matrix, its centre and radius, and codes of one byte per entry for the
way from the centre. Searching compares questions with centres first; by the triangle inequality a
cell farther than the k-th best upper bound holds no answer, so it is skipped before any join.
The exact search then opens the few cells that surely hold k vectors, and of the rest only those that
can beat what these gave. The coded search reads codes of open cells and the vectors of a few
candidates only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators.neighbours import _ARROW, _by_block, _distances, _ids, _least, _matrix, _paired, _unit, nearest, packed
from threadloom.operators.ranking import top_k
from threadloom.session import placed, written

ROWS = 512
#: Children of a cell that is split, and vectors of it that train their centres.
FAN, TRAIN = 64, 4096
LEVELS = 4
#: Cells of a group that meet its questions in one task.
BUNDLE = 16
#: Distances are ranked after rounding, so bounds within this much of each other are equal.
SLACK = 2e-6


@dataclass(frozen=True)
class VectorIndex:
    """``shelves`` (group, _block, cells, centres, radii, sizes) and ``blocks`` (group, cell, ids, vecs, codes, scale)."""

    shelves: DataFrame
    blocks: DataFrame
    group: str
    item: str


def _centres(rows: pd.DataFrame, fan: int, rounds: int) -> np.ndarray:
    """Directions of ``fan`` clusters at most, from vectors spread by farthest points, moved to their means."""
    vectors = _unit(np.array(rows["vec"].tolist(), dtype=np.float64))
    chosen = [0]
    far = np.full(len(vectors), np.inf)
    while len(chosen) < min(fan, len(vectors)):
        far = np.minimum(far, 1.0 - vectors @ vectors[chosen[-1]])
        if far.max() <= 1e-12:
            break
        chosen.append(int(far.argmax()))
    centres = vectors[chosen]
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        moved = _unit(sums)
        centres = np.where(np.abs(moved).sum(1, keepdims=True) > 0, moved, centres)
    return centres


def _trained(part: DataFrame, spot: str, item: str, fan: int, rows: int, rounds: int) -> DataFrame:
    """(spot, cell, vec): centres of every spot, from the ``TRAIN`` vectors of it with the least hash."""
    order = [F.xxhash64(F.col(item).cast("string")), F.asc(item)]
    sample = top_k(part.select(spot, item, "vec", "_n"), [spot], order, TRAIN, "_at")

    def train(group: pd.DataFrame) -> pd.DataFrame:
        count = min(fan, max(2, int(np.ceil(2 * group["_n"].iloc[0] / rows))))
        centres = _centres(group.sort_values("_at"), count, rounds)
        return pd.DataFrame({spot: group[spot].iloc[0], "cell": np.arange(len(centres)), "vec": list(centres)})

    return sample.groupBy(spot).applyInPandas(train, f"{spot} string, cell long, vec array<double>")


def _split(vectors: DataFrame, item: str, group: str, rows: int, fan: int, rounds: int) -> DataFrame:
    """``vectors`` with the ``cell`` of each, of about ``rows`` vectors."""
    zero = F.forall("vec", lambda x: x == 0)
    placed = written(vectors.select(group, item, "vec", F.when(zero, "z").otherwise("").alias("_path")), "placed")
    for _ in range(LEVELS):
        sizes = placed.groupBy(group, "_path").agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > rows) & ~F.col("_path").rlike("[z=]$"))
        sizes = written(sizes, "sizes")
        if sizes.isEmpty():
            break
        spot = F.concat("_path", F.lit("|"), F.col(group).cast("string"))
        large = written(placed.join(sizes, [group, "_path"]).withColumn("_spot", spot), "large")
        centres = written(_trained(large, "_spot", item, fan, rows, rounds), "centres")
        own = nearest(large, centres, 1, "angular", item, "cell", "_spot").select("_spot", item, "cell")
        ends = centres.groupBy("_spot").agg(F.when(F.count(F.lit(1)) == 1, "=").otherwise("/").alias("_end"))
        moved = large.join(own, ["_spot", item]).join(ends, "_spot").withColumn("_path", F.concat("_path", F.col("cell").cast("string"), "_end"))
        rest = placed.join(sizes, [group, "_path"], "left_anti")
        placed = written(rest.unionByName(moved.select(rest.columns)), "placed")
    # Vectors that no centre tells apart, such as copies, are dealt by id.
    counts = placed.groupBy(group, "_path").agg(F.ceil(F.count(F.lit(1)) / rows).alias("_pieces"))
    piece = F.pmod(F.xxhash64(F.col(item).cast("string")), F.col("_pieces")).cast("string")
    return placed.join(counts, [group, "_path"]).select(group, item, "vec", F.concat("_path", F.lit("#"), piece).alias("cell"))


def _described(lists: DataFrame, group: str, item: str) -> DataFrame:
    """Cells with their centre, radius and codes, from lists of (id, vec)."""
    kinds = {f.name: f.dataType for f in lists.schema.fields}
    fields = [
        T.StructField(group, kinds[group]), T.StructField("cell", T.StringType()), T.StructField("v_ids", kinds["v_ids"]),
        T.StructField("v_vecs", kinds["v_vecs"]), T.StructField("size", T.LongType()), T.StructField("centre", T.ArrayType(T.DoubleType())),
        T.StructField("radius", T.DoubleType()), T.StructField("codes", T.BinaryType()), T.StructField("scale", T.DoubleType()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, list] = {"size": [], "centre": [], "radius": [], "codes": [], "scale": []}
            for cell in batch.column("v_vecs"):
                unit = _unit(_matrix(cell))
                centre = _unit(unit.sum(0, keepdims=True))
                rest = unit - centre
                scale = float(np.abs(rest).max(initial=0.0)) / 127 or 1.0
                made["size"].append(len(unit))
                made["centre"].append(centre[0])
                made["radius"].append(float(_distances("angular", centre, unit).max()) if centre.any() else 2.0 * unit.any())
                made["codes"].append(np.round(rest / scale).astype(np.int8).tobytes())
                made["scale"].append(scale)
            names = [group, "cell", "v_ids", "v_vecs"]
            kinds_of = [pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.binary(), pa.float64()]
            arrays = [*[batch.column(n) for n in names], *[pa.array(v, type=t) for v, t in zip(made.values(), kinds_of)]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *made])

    return lists.select(group, "cell", "v_ids", "v_vecs").mapInArrow(run, T.StructType(fields))


def build(
    vectors: DataFrame, path: str, item: str = "comment_id", group: str = "tag", rows: int = ROWS, fan: int = FAN, rounds: int = 8
) -> VectorIndex:
    """Write the index of ``vectors`` (group, item, vec) to ``path`` and load it.

    Centres are trained on at most ``TRAIN`` vectors of the cell they split, chosen by a hash of their
    id; every vector is stored. Ids must be unique within a group. Zero vectors have cells of their own.
    """
    spark = vectors.sparkSession
    cells = _split(vectors, item, group, rows, fan, rounds)
    held = F.collect_list(F.struct(F.col(item).alias("id"), "vec"))  # about ``rows`` vectors
    lists = cells.groupBy(group, "cell").agg(held.alias("rows")).select(group, "cell", F.col("rows.id").alias("v_ids"), F.col("rows.vec").alias("v_vecs"))
    _described(lists, group, item).write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    counts = blocks.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / ROWS).alias("_blocks"))
    numbered = blocks.join(counts, group).withColumn("_block", F.pmod(F.xxhash64("cell"), F.col("_blocks")))
    row = F.collect_list(F.struct("cell", "centre", "radius", "size")).alias("rows")
    shelves = numbered.groupBy(group, "_block", "_blocks").agg(row).select(
        group, "_block", "_blocks", F.col("rows.cell").alias("cells"), F.col("rows.centre").alias("v_vecs"),
        F.col("rows.radius").alias("radii"), F.col("rows.size").alias("sizes"),
    )
    shelves.write.parquet(f"{path}/shelves")
    return load(spark, path, item, group)


def load(spark: SparkSession, path: str, item: str = "comment_id", group: str = "tag") -> VectorIndex:
    """A stored index; nothing but file footers is read until it is searched."""
    return VectorIndex(spark.read.parquet(f"{path}/shelves"), spark.read.parquet(f"{path}/blocks"), group, item)


def _cell_bounds(questions: DataFrame, index: VectorIndex, k: int | None, question: str) -> DataFrame:
    """(question, group, cell, lower, upper, size): bounds of the distances to the vectors of each cell.

    With ``k``, cells beyond the k-th best upper bound of their shelf do not come out at all.
    """
    group = index.group
    kinds = {f.name: f.dataType for f in questions.schema.fields}
    schema = T.StructType([
        T.StructField(group, kinds[group]), T.StructField(question, kinds[question]), T.StructField("cell", T.StringType()),
        T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType()), T.StructField("size", T.LongType()),
    ])

    def bounds(q: np.ndarray, centres: np.ndarray, row: dict) -> dict:
        gap = _distances("angular", q, centres)
        radius, size = np.array(row["radii"].as_py()), np.array(row["sizes"].as_py())
        lower, upper = np.maximum(gap - radius, 0.0), gap + radius
        last = np.full(len(q), np.inf)
        if k is not None:
            order = np.argsort(upper, axis=1, kind="stable")
            enough = np.cumsum(size[order], axis=1) >= k
            last = np.where(enough.any(1), np.take_along_axis(upper, order, axis=1)[np.arange(len(q)), enough.argmax(1)], np.inf)
        at, cell = np.nonzero(lower <= last[:, None] + SLACK)
        return {
            question: _ids(row["q_ids"])[at], "cell": np.array(row["cells"].as_py())[cell], "lower": lower[at, cell],
            "upper": upper[at, cell], "size": size[cell],
        }

    counts = index.shelves.select(group, "_blocks").distinct()
    pairs = _paired(packed(questions, group, question, "vec", "q"), index.shelves.drop("_blocks"), counts, group)
    return _by_block(pairs, group, schema, bounds).select(question, group, "cell", "lower", "upper", "size")


def open_cells(questions: DataFrame, index: VectorIndex, k: int, question: str = "qid") -> DataFrame:
    """(question, group, cell, lower, upper, size, before): cells that may hold one of the ``k`` nearest.

    ``before`` counts the vectors of cells with smaller upper bounds: those below ``k`` are sure to
    hold k vectors within the last of these bounds, and cells whose lower bound is beyond it are left out.
    """
    group = index.group
    near = _cell_bounds(questions, index, k, question)
    ahead = Window.partitionBy(question, group).orderBy("upper", "cell").rowsBetween(Window.unboundedPreceding, -1)
    counted = near.withColumn("before", F.coalesce(F.sum("size").over(ahead), F.lit(0).cast("bigint")))
    whole = Window.partitionBy(question, group)
    sure = F.max(F.when(F.col("before") < k, F.col("upper"))).over(whole)
    bounded = counted.withColumn("_sure", sure).withColumn("_total", F.sum("size").over(whole))
    return bounded.where((F.col("_total") < k) | (F.col("lower") <= F.col("_sure") + SLACK)).drop("_sure", "_total")


def _spot(group: str) -> Column:
    return F.concat("cell", F.lit("|"), F.col(group).cast("string"))


def _in_bundles(
    opened: DataFrame, questions: DataFrame, index: VectorIndex, columns: list[str], k: int, question: str,
    compared: Callable[[np.ndarray, dict], np.ndarray],
) -> DataFrame:
    """(question, group, cell, item, distances): the ``k`` least of ``compared`` over the opened cells of each bundle.

    ``BUNDLE`` cells of a group lie in one task, followed by the questions that opened any of them: a
    question's vector travels once per bundle, and ``k`` rows come out per bundle rather than per cell. A
    task holds the cells of one bundle; questions pass as a stream. ``compared`` gets questions and the
    ``columns`` of a cell.
    """
    group, item = index.group, index.item
    kinds = {f.name: f.dataType for f in questions.schema.fields}
    ids = index.blocks.schema["v_ids"].dataType.elementType
    bundles = index.shelves.select(group, F.size("cells").alias("n")).groupBy(group).agg(F.ceil(F.sum("n") / BUNDLE).alias("_bundles"))
    bundle = F.concat(F.pmod(F.xxhash64("cell"), F.col("_bundles")).cast("string"), F.lit("|"), F.col(group).cast("string")).alias("_bundle")
    cells = opened.join(bundles, group).select(question, group, "cell", bundle)
    asked = cells.groupBy(question, group, "_bundle").agg(F.collect_list("cell").alias("q_cells")).join(questions.select(question, group, "vec"), [question, group])
    wanted = opened.select(group, "cell").distinct()
    stored = index.blocks.join(wanted, [group, "cell"], "left_semi").join(bundles, group).select(bundle, "cell", "v_ids", *columns)
    nothing = [F.lit(None).cast(t).alias(n) for n, t in [(question, kinds[question]), (group, kinds[group]), ("vec", kinds["vec"]), ("q_cells", "array<string>")]]
    held = stored.select("_bundle", F.lit(False).alias("is_asked"), "cell", "v_ids", *columns, *nothing)
    empty = [F.lit(None).cast(index.blocks.schema[n].dataType).alias(n) for n in ("cell", "v_ids", *columns)]
    asking = asked.select("_bundle", F.lit(True).alias("is_asked"), *empty, question, group, "vec", "q_cells")
    schema = T.StructType([
        T.StructField(question, kinds[question]), T.StructField(group, kinds[group]), T.StructField("cell", T.StringType()),
        T.StructField(item, ids), T.StructField("distances", T.DoubleType()),
    ])
    target = pa.schema([(f.name, _ARROW[type(f.dataType)]) for f in schema.fields])

    def found(rows: pa.RecordBatch, cells: dict[str, dict]) -> pa.RecordBatch | None:
        vectors = np.asarray(rows["vec"].flatten(), dtype=np.float64).reshape(rows.num_rows, -1)
        lists = rows["q_cells"]
        of = np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy()))
        names = np.asarray(lists.flatten().to_pylist(), dtype=object)
        parts = []
        for name in dict.fromkeys(names.tolist()):
            cell, at = cells[name], of[names == name]
            gap = compared(vectors[at], cell)
            chosen = _least(gap, cell["v_ids"], min(k, len(cell["v_ids"])))
            size = chosen.shape[1]
            parts.append((np.repeat(at, size), np.full(chosen.size, name, dtype=object), cell["v_ids"][chosen.ravel()], np.take_along_axis(gap, chosen, axis=1).ravel()))
        if not parts:
            return None
        at, name, own, gap = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((own, gap, at))
        at = at[order]
        first = np.searchsorted(at, at, side="left")
        order, at = order[np.arange(len(at)) - first < k], at[np.arange(len(at)) - first < k]
        values = [rows[question].take(pa.array(at)), rows[group].take(pa.array(at)), pa.array(name[order]), pa.array(own[order].tolist()), pa.array(gap[order])]
        return pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, cells = None, {}
        for batch in batches:
            names, is_asked = batch["_bundle"].to_pylist(), batch["is_asked"].to_pylist()
            low = 0
            while low < batch.num_rows:
                if names[low] != current:
                    current, cells = names[low], {}
                if not is_asked[low]:
                    row = {n: batch[n][low] for n in ("v_ids", *columns)}
                    cells[batch["cell"][low].as_py()] = row | {"v_ids": _ids(row["v_ids"])}
                    low += 1
                    continue
                high = low
                while high < batch.num_rows and high - low < ROWS and names[high] == current and is_asked[high]:
                    high += 1
                out = found(batch.slice(low, high - low), cells)
                if out is not None:
                    yield out
                low = high

    return placed(held.unionByName(asking), "_bundle").sortWithinPartitions("_bundle", "is_asked").mapInArrow(run, schema)


def _scanned(opened: DataFrame, questions: DataFrame, index: VectorIndex, k: int, question: str, decimals: int) -> DataFrame:
    """(question, group, item, distances): the ``k`` nearest of the opened cells of each bundle."""

    def compared(q: np.ndarray, cell: dict) -> np.ndarray:
        return np.round(_distances("angular", q, _matrix(cell["v_vecs"])), decimals) + 0.0

    found = _in_bundles(opened, questions, index, ["v_vecs"], k, question, compared)
    return found.select(question, index.group, index.item, "distances")


def search(questions: DataFrame, index: VectorIndex, k: int, question: str = "qid", decimals: int = 6) -> DataFrame:
    """The ``k`` nearest vectors by angular distance within each group of a question, exactly.

    Gives (question, group, item, distances, rank); distances are rounded before they are ranked, ties
    go to the lower item. Groups that the index does not hold give no rows.
    """
    group, item = index.group, index.item
    order = [F.asc("distances"), F.asc(item)]
    opened = written(open_cells(questions, index, k, question), "opened")
    first = written(_scanned(opened.where(F.col("before") < k), questions, index, k, question, decimals), "first")
    reached = top_k(first, [question, group], order, k).groupBy(question, group).agg(
        F.max("distances").alias("_worst"), F.count(F.lit(1)).alias("_held")
    )
    rest = opened.where(F.col("before") >= k).join(reached, [question, group])
    further = rest.where((F.col("_held") < k) | (F.col("lower") <= F.col("_worst") + SLACK))
    second = _scanned(further, questions, index, k, question, decimals)
    return top_k(first.unionByName(second), [question, group], order, k)


def coded_search(
    questions: DataFrame, index: VectorIndex, k: int, question: str = "qid", refine: int = 4, share: float = 0.1, decimals: int = 6
) -> DataFrame:
    """Approximate neighbours by codes: only a few vectors of a group are read.

    Codes of the open cells are compared; the best ``refine`` * k of a question, but no more than
    ``share`` of its group (k at least), are then scored on their vectors. Gives (question, group,
    item, distances, rank, scored) with k rows wherever the group has k; ``scored`` counts the vectors read.
    """
    group, item = index.group, index.item
    opened = written(open_cells(questions, index, k, question), "opened")

    def compared(q: np.ndarray, cell: dict) -> np.ndarray:
        way = np.frombuffer(cell["codes"].as_py(), np.int8).reshape(len(cell["v_ids"]), -1) * cell["scale"].as_py()
        return np.sqrt(np.maximum(2.0 - 2.0 * (_unit(q) @ (way + np.array(cell["centre"].as_py())).T), 0.0))

    coded = _in_bundles(opened, questions, index, ["centre", "codes", "scale"], refine * k, question, compared).withColumn("_spot", _spot(group))
    sizes = index.shelves.select(group, F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n")).groupBy(group).agg(F.sum("n").alias("_n"))
    ranked = top_k(coded, [question, group], [F.asc("distances"), F.asc(item)], refine * k, "_at").join(sizes, group)
    few = written(ranked.where(F.col("_at") <= F.greatest(F.lit(k), F.floor(F.col("_n") * share))).select(question, group, "cell", "_spot", item), "few")
    wanted = few.select("_spot", question, group, item).join(questions.select(question, group, "vec"), [question, group])
    asked_ids = few.groupBy("_spot").agg(F.collect_set(item).alias("_wanted"))  # at most a cell
    stored = index.blocks.withColumn("_spot", _spot(group)).select("_spot", "v_ids", "v_vecs").join(asked_ids, "_spot")
    chosen = F.filter(F.arrays_zip("v_ids", "v_vecs"), lambda v: F.array_contains("_wanted", v["v_ids"]))
    exact = stored.select("_spot", F.explode(chosen).alias("v")).select("_spot", F.col("v.v_ids").alias(item), F.col("v.v_vecs").alias("_own"))
    dot, one, two = (F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for a, b in (("vec", "_own"), ("vec", "vec"), ("_own", "_own")))
    cos = F.when((one == 0) | (two == 0), 0.0).otherwise(F.least(F.greatest(dot / F.sqrt(one * two), F.lit(-1.0)), F.lit(1.0)))
    scored = wanted.join(exact, ["_spot", item]).select(question, group, item, F.round(F.sqrt(2 * (1 - cos)), decimals).alias("distances"))
    read = few.groupBy(question, group).agg(F.count(F.lit(1)).alias("scored"))
    return top_k(scored, [question, group], [F.asc("distances"), F.asc(item)], k).join(read, [question, group])


def _own_cells(asked: DataFrame, index: VectorIndex) -> tuple[DataFrame, DataFrame]:
    """Cells to score for each document (group, item, cell, size, border), and the ``whole`` vectors nearer than it.

    ``asked`` is (group, item, vec, own). Cells that its own score settles are summed up next to their
    bounds, so a row is written per document and shelf and per cell to score, not per cell. A first pass
    finds the score that two vectors of a shelf reach at least: one of them is another document.
    """
    group, item = index.group, index.item
    kinds = {f.name: f.dataType for f in asked.schema.fields}
    keys = [T.StructField(group, kinds[group]), T.StructField(item, kinds[item])]
    counts = index.shelves.select(group, "_blocks").distinct()

    def scores(q: np.ndarray, centres: np.ndarray, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        gap, radius = _distances("angular", q, centres), np.array(row["radii"].as_py())
        lower, upper = np.maximum(gap - radius, 0.0), gap + radius
        return 1 - lower * lower / 2, 1 - upper * upper / 2, upper, np.array(row["sizes"].as_py())

    def reached(q: np.ndarray, centres: np.ndarray, row: dict) -> dict:
        _, low, upper, size = scores(q, centres, row)
        order = np.argsort(upper, axis=1, kind="stable")
        needed = np.cumsum(size[order], axis=1) - size[order] < 2
        sure = np.where(needed, np.take_along_axis(low, order, axis=1), np.inf).min(1)
        return {item: _ids(row["q_ids"]), "sure": sure if size.sum() >= 2 else np.full(len(q), -np.inf)}

    def marked(q: np.ndarray, centres: np.ndarray, row: dict) -> dict:
        high, low, _, size = scores(q, centres, row)
        own, sure = (np.array(row[n].as_py())[:, None] for n in ("q_own", "q_sure"))
        border = (high >= own - SLACK) & (low <= own + SLACK)
        at, cell = np.nonzero(border | (high >= sure - SLACK))
        ids, names = _ids(row["q_ids"]), row["cells"].as_py()
        whole = (size * (~border & (low > own))).sum(1)
        return {
            item: np.concatenate((ids[at], ids)), "cell": [*[names[c] for c in cell], *[None] * len(ids)],
            "size": np.concatenate((size[cell], whole)), "border": np.concatenate((border[at, cell], np.zeros(len(ids)))).astype(np.int32),
        }

    shelves = index.shelves.drop("_blocks")
    first = _paired(packed(asked, group, item, "vec", "q"), shelves, counts, group)
    sure = _by_block(first, group, T.StructType([*keys, T.StructField("sure", T.DoubleType())]), reached).groupBy(group, item).agg(F.max("sure").alias("sure"))
    second = _paired(packed(asked.join(sure, [group, item]), group, item, "vec", "q", ["own", "sure"]), shelves, counts, group)
    cells = [T.StructField("cell", T.StringType()), T.StructField("size", T.LongType()), T.StructField("border", T.IntegerType())]
    judged = written(_by_block(second, group, T.StructType([*keys, *cells]), marked), "judged")
    return judged.where("cell is not null"), judged.where("cell is null").groupBy(group, item).agg(F.sum("size").alias("whole"))


def own_rank(probes: DataFrame, index: VectorIndex, vectors: DataFrame, decimals: int = 6) -> DataFrame:
    """Where each document stands in its group when searched by its probe vector, as ``neighbours.own_rank``.

    Cells that the radius proves nearer or farther than the document itself are counted whole. Only
    cells on the border, and those that may hold the best other document, are scored. ``probes`` and
    ``vectors`` are (group, item, vec); gives (group, item, rank, runner_up, scored).
    """
    group, item = index.group, index.item
    kinds = {f.name: f.dataType for f in vectors.schema.fields}
    both = probes.select(group, item, "vec").join(vectors.select(group, item, F.col("vec").alias("_theirs")), [group, item])
    dot, one, two = (F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for a, b in (("vec", "_theirs"), ("vec", "vec"), ("_theirs", "_theirs")))
    cos = F.when((one == 0) | (two == 0), 0.0).otherwise(F.least(F.greatest(dot / F.sqrt(one * two), F.lit(-1.0)), F.lit(1.0)))
    asked = written(both.select(group, item, "vec", cos.alias("own")), "asked")
    opened, whole = _own_cells(asked, index)
    packs = packed(opened.join(asked, [group, item]).withColumn("_spot", _spot(group)), "_spot", item, "vec", "q", ["own", "border"]).drop("_block")
    stored = index.blocks.withColumn("_spot", _spot(group)).select("_spot", "v_ids", "v_vecs")
    schema = T.StructType([
        T.StructField("_spot", T.StringType()), T.StructField(item, kinds[item]), T.StructField("ahead", T.LongType()),
        T.StructField("other", kinds[item]), T.StructField("score", T.DoubleType()),
    ])

    def count(q: np.ndarray, v: np.ndarray, row: dict) -> dict:
        a, b = _ids(row["q_ids"]), _ids(row["v_ids"])
        score = np.round(_distances("cosine", q, v), decimals) + 0.0
        own = np.round(np.array(row["q_own"].as_py()), decimals)[:, None] + 0.0
        others = a[:, None] != b[None, :]
        ahead = others & ((score > own) | ((score == own) & (b[None, :] < a[:, None])))
        seen = np.where(others, score, -np.inf)
        order = np.argsort(b, kind="stable")
        pick = order[np.argmax(seen[:, order], axis=1)]
        return {item: a, "ahead": ahead.sum(1) * np.array(row["q_border"].as_py()), "other": b[pick], "score": np.take_along_axis(seen, pick[:, None], axis=1).ravel()}

    names = opened.select(_spot(group).alias("_spot"), group).distinct()
    counts = _by_block(stored.join(packs, "_spot"), "_spot", schema, count).join(names, "_spot")
    best = F.max_by("other", F.struct("score", (-F.col("other")).alias("o")))
    found = counts.groupBy(group, item).agg(F.sum("ahead").alias("ahead"), best.alias("runner_up"))
    read = opened.groupBy(group, item).agg(F.sum("size").alias("scored"))
    rank = F.col("ahead") + F.coalesce("whole", F.lit(0)) + 1
    return found.join(whole, [group, item], "left").join(read, [group, item]).select(group, item, rank.alias("rank"), "runner_up", "scored")
