"""Nearest neighbours: exact by blocks, approximate by cells around centres.

Both sides are packed into blocks of bounded size that share a group (a tag). A pair of blocks is
one row; a task multiplies the two small matrices and passes on only the ``k`` best per question, so
no pair of vectors is ever a row and nothing goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators.ranking import top_k

BLOCK_ROWS = 512
#: Questions whose blocks may be broadcast: 4 MB at 128 dimensions.
FEW_QUESTIONS = 4096


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _least(values: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """Columns of the ``size`` least values of each row, in order, ties to the lower id."""
    ascending = np.argsort(ids, kind="stable")
    ordered = values[:, ascending]
    if size == 1:  # the first of the least ones, without a sort
        return ascending[ordered.argmin(1)[:, None]]
    return ascending[np.argsort(ordered, axis=1, kind="stable")[:, :size]]


def _distances(metric: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distance (or, for ``dot`` and ``cosine``, similarity) of every question to every vector.

    angular is the Euclidean distance of unit vectors, with cosine 0 for a zero vector; hamming
    counts differing bits, a bit being set where the entry is above one half.
    """
    if metric == "dot":
        return q @ v.T
    if metric in ("cosine", "angular"):
        cos = np.clip(_unit(q) @ _unit(v).T, -1.0, 1.0)
        return cos if metric == "cosine" else np.sqrt(2.0 * (1.0 - cos))
    if metric == "hamming":
        a, b = (q > 0.5).astype(float), (v > 0.5).astype(float)
        return a.sum(1)[:, None] + b.sum(1)[None, :] - 2.0 * (a @ b.T)
    order = {"manhattan": 1, "euclidean": 2}[metric]
    return np.stack([np.linalg.norm(v - row, ord=order, axis=1) for row in q])


def larger_is_closer(metric: str) -> bool:
    return metric in ("dot", "cosine")


def _block_counts(vectors: DataFrame, group: str) -> DataFrame:
    return vectors.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("_blocks"))


def packed(
    vectors: DataFrame, group: str, item: str, vec: str, prefix: str, extra: Sequence[str] = ()
) -> DataFrame:
    """Rows of (group, block) with parallel arrays of ids, vectors and extra fields.

    A group of n rows is hashed into n / BLOCK_ROWS blocks, so blocks keep their size however large
    a group is and a hot group simply has more of them.
    """
    placed = vectors.join(_block_counts(vectors, group), group)
    bucket = F.pmod(F.xxhash64(item), F.col("_blocks")).alias("_block")
    rows = F.collect_list(F.struct(F.col(item).alias("id"), F.col(vec).alias("vec"), *extra))
    lists = placed.groupBy(group, bucket).agg(rows.alias("rows"))
    names = {"id": f"{prefix}_ids", "vec": f"{prefix}_vecs", **{e: f"{prefix}_{e}" for e in extra}}
    return lists.select(group, "_block", *[F.col("rows")[field].alias(name) for field, name in names.items()])


def _paired(questions: DataFrame, vectors: DataFrame, counts: DataFrame, group: str) -> DataFrame:
    """Every question block next to every vector block of its group.

    The join key is (group, vector block): question blocks repeat once per block of their group, so a
    hot group has as many keys as blocks. Spark sizes the repeated blocks as if they stood there once and
    would broadcast them by that size, so the join is sorted.
    """
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("_block")
    repeated = questions.drop("_block").join(counts, group).select(*[c for c in questions.columns if c != "_block"], copies)
    return vectors.join(repeated.hint("merge"), [group, "_block"]).drop("_block")


def _of_asked(questions: DataFrame, vectors: DataFrame, group: str) -> DataFrame:
    """Vectors of the groups that are asked for; folders of others stay unread."""
    return vectors.join(questions.select(group).distinct(), group, "left_semi")


def _matrix(cell: pa.ListScalar) -> np.ndarray:
    lists = cell.values
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)


def _ids(cell: pa.ListScalar) -> np.ndarray:
    """Ids as an array that sorts the way Spark sorts them (text by code point)."""
    return np.asarray(cell.values.to_pylist())


BlockFunction = Callable[[np.ndarray, np.ndarray, dict], dict]


_ARROW = {
    T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.StringType: pa.string(),
}


def _by_block(pairs: DataFrame, group: str, schema: T.StructType, work: BlockFunction) -> DataFrame:
    target = pa.schema([(f.name, _ARROW[type(f.dataType)]) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                out = work(_matrix(row["q_vecs"]), _matrix(row["v_vecs"]), row)
                out[group] = [row[group].as_py()] * len(next(iter(out.values())))
                columns = [pa.array(out[f.name], type=f.type) for f in target]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return pairs.mapInArrow(run, schema)


def nearest(
    questions: DataFrame,
    vectors: DataFrame,
    k: int | None,
    metric: str = "angular",
    question: str = "qid",
    item: str = "comment_id",
    group: str | None = None,
    vec: str = "vec",
    decimals: int = 6,
    few: bool = False,
) -> DataFrame:
    """The ``k`` nearest vectors of each question within each of its groups; all of them for ``k=None``.

    ``questions`` is (question, [group], vec), ``vectors`` is (item, [group], vec). Distances are
    rounded before they are ranked, ties go to the lower item. Without a group there is one. ``few`` says
    that there are no more than ``FEW_QUESTIONS``, whose blocks then go to every task as they are.
    """
    key = group or "_all"
    if group is None:
        questions = questions.withColumn(key, F.lit(0))
        vectors = vectors.withColumn(key, F.lit(0))
    sign = -1.0 if larger_is_closer(metric) else 1.0
    kinds = {f.name: f.dataType for f in [*questions.schema.fields, *vectors.schema.fields]}
    schema = T.StructType([
        T.StructField(key, kinds[key]),
        T.StructField(question, kinds[question]),
        T.StructField(item, kinds[item]),
        T.StructField("distances", T.DoubleType()),
    ])

    def best(q: np.ndarray, v: np.ndarray, row: dict) -> dict:
        q_ids, v_ids = _ids(row["q_ids"]), _ids(row["v_ids"])
        gap = np.round(_distances(metric, q, v), decimals) + 0.0
        size = len(v_ids) if k is None else min(k, len(v_ids))
        chosen = _least(sign * gap, v_ids, size)
        return {
            question: np.repeat(q_ids, size),
            item: v_ids[chosen.ravel()],
            "distances": np.take_along_axis(gap, chosen, axis=1).ravel(),
        }

    if group is not None:
        vectors = _of_asked(questions, vectors, key)
    counts = _block_counts(vectors, key)
    asked, stored = packed(questions, key, question, vec, "q"), packed(vectors, key, item, vec, "v")
    pairs = stored.join(F.broadcast(asked.drop("_block")), key).drop("_block") if few else _paired(asked, stored, counts, key)
    scored = _by_block(pairs, key, schema, best)
    if group is None:
        scored = scored.drop(key)
    if k is None:
        return scored
    towards = F.desc("distances") if larger_is_closer(metric) else F.asc("distances")
    return top_k(scored, [question, *([group] if group else [])], [towards, F.asc(item)], k)


def own_rank(
    probes: DataFrame, vectors: DataFrame, item: str = "comment_id", group: str = "tag", decimals: int = 6
) -> DataFrame:
    """Where each document stands among all of its group when searched by its probe vector.

    Gives the 1-based ``rank`` of the document itself by cosine (lower id first on ties) and the
    best other document as ``runner_up``. Each pair of blocks answers with a count and one
    candidate per probe; the counts add up.
    """
    kinds = {f.name: f.dataType for f in vectors.schema.fields}
    own = vectors.select(group, item, F.col("vec").alias("own"))
    probes = probes.join(own, [group, item])
    schema = T.StructType([
        T.StructField(group, kinds[group]),
        T.StructField(item, kinds[item]),
        T.StructField("ahead", T.LongType()),
        T.StructField("other", kinds[item]),
        T.StructField("score", T.DoubleType()),
    ])

    def ahead(q: np.ndarray, v: np.ndarray, row: dict) -> dict:
        a, b = _ids(row["q_ids"]), _ids(row["v_ids"])
        cos = np.round(_distances("cosine", q, v), decimals) + 0.0
        own_cos = np.round((_unit(q) * _unit(_matrix(row["q_own"]))).sum(1), decimals)[:, None] + 0.0
        others = a[:, None] != b[None, :]
        before = others & ((cos > own_cos) | ((cos == own_cos) & (b[None, :] < a[:, None])))
        seen = np.where(others, cos, -np.inf)
        order = np.argsort(b, kind="stable")
        pick = order[np.argmax(seen[:, order], axis=1)]
        score = np.take_along_axis(seen, pick[:, None], axis=1).ravel()
        return {item: a, "ahead": before.sum(1), "other": b[pick], "score": score}

    stored = _of_asked(probes, vectors, group)
    asked = packed(probes, group, item, "vec", "q", ["own"])
    pairs = _paired(asked, packed(stored, group, item, "vec", "v"), _block_counts(stored, group), group)
    counts = _by_block(pairs, group, schema, ahead)
    best = F.max_by("other", F.struct("score", (-F.col("other")).alias("o")))
    return counts.groupBy(group, item).agg((F.sum("ahead") + 1).alias("rank"), best.alias("runner_up"))


def approximate_nearest(
    questions: DataFrame,
    vectors: DataFrame,
    k: int,
    share: float = 0.5,
    at_least: int = 256,
    cells: int = 64,
    question: str = "qid",
    item: str = "comment_id",
    group: str = "tag",
) -> DataFrame:
    """Approximate angular neighbours: ``k`` rows per question and group wherever the group has ``k``.

    Some vectors of a group, chosen by a hash of their id (about the square root of its size, ``cells``
    at most), are centres; every vector belongs to the nearest one. A question looks into the cells of
    the nearest centres, widening until they hold ``share`` of the group, ``at_least`` vectors and ``k``,
    or the group is used up.
    Candidates are searched exactly within (group, cell), so pairs of other groups never form.
    ``vectors`` is read several times and should be a stored table.
    """
    vectors = _of_asked(questions, vectors, group).select(group, item, "vec")
    sizes = vectors.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    hashed = F.xxhash64(F.col(item).cast("string"))
    centres = top_k(vectors.withColumn("_h", hashed), [group], [F.asc("_h"), F.asc(item)], cells, "_at").join(sizes, group)
    centres = centres.where(F.col("_at") <= F.ceil(F.sqrt("_n"))).select(group, F.col(item).alias("cell"), "vec")
    owned = nearest(vectors, centres, 1, "angular", item, "cell", group).select(group, item, "cell")
    held = owned.groupBy(group, "cell").agg(F.count(F.lit(1)).alias("_held"))
    probed = nearest(questions, centres, cells, "angular", question, "cell", group).join(held, [group, "cell"]).join(sizes, group)
    nearer = Window.partitionBy(question, group).orderBy("distances", "cell").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_held").over(nearer), F.lit(0))
    opened = probed.withColumn("_before", before).where(F.col("_before") < F.greatest(F.lit(max(k, at_least)), F.col("_n") * share))
    spot = F.struct(F.col(group).cast("string").alias("g"), F.col("cell").cast("string").alias("c")).cast("string")
    stored = vectors.join(owned, [group, item]).select(spot.alias("_spot"), item, "vec")
    asked = questions.join(opened.select(question, group, "cell"), [question, group]).select(spot.alias("_spot"), question, group, "vec")
    found = nearest(asked.select("_spot", question, "vec"), stored, k, "angular", question, item, "_spot")
    named = found.join(asked.select("_spot", question, group), ["_spot", question]).select(question, group, item, "distances")
    return top_k(named, [question, group], [F.asc("distances"), F.asc(item)], k)
