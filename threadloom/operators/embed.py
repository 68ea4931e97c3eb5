"""Text vectors as (weighted) means of word vectors.

``words`` is a table (word, vec array<double>) that holds a word once. A table whose size allows it is
broadcast, and the per-text sums combine on the map side. A larger one is joined with the distinct words
of blocks of texts: a vector travels once per block and word, never per token, and each block is one
sparse by dense product.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.text import whitespace_tokens
from threadloom.operators.aggregates import mean_vector
from threadloom.operators.neighbours import FEW_QUESTIONS, nearest
from threadloom.session import written


def text_tokens(texts: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row per token; a text without tokens keeps one row with a null word."""
    return texts.select(*keys, F.explode_outer(whitespace_tokens(F.col(text))).alias("word"))


def weighted_words(
    words: DataFrame, idf: DataFrame | None = None, unknown: float = 0.0, zero: float | None = None
) -> DataFrame:
    """Word vectors with a ``weight``: 1, or the idf of the word.

    ``unknown`` stands in for a missing idf, ``zero`` (if given) for one that is 0.
    """
    if idf is None:
        return words.select("word", "vec", F.lit(1.0).alias("weight"))
    known = idf.select(F.col("term").alias("word"), "idf")
    weight = F.coalesce("idf", F.lit(unknown))
    if zero is not None:
        weight = F.when(weight == 0, F.lit(zero)).otherwise(weight)
    return words.join(known, "word", "left").select("word", "vec", weight.alias("weight"))


#: Word tables up to this size are broadcast.
BROADCAST_BYTES = 128 << 20
#: Text per block where the word table is larger.
BLOCK_BYTES = 2 << 20
#: Texts per task where it is broadcast.
BLOCK_TEXTS = 1 << 13


def mean_vectors(
    texts: DataFrame, keys: Sequence[str], text: str, words: DataFrame, dim: int, name: str = "vec",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Mean of ``weight * vec`` over the tokens that have a vector; zeros if none has.

    ``words`` comes from :func:`weighted_words`. It is broadcast if its vectors fill at most
    ``broadcast_bytes``, see :func:`blocked_mean_vectors` for what happens beyond: that reads the texts
    several times, so they are worked out once and stored.
    """
    if words.count() * dim * 8 > broadcast_bytes:
        return blocked_mean_vectors(written(texts.select(*keys, text), "texts"), keys, text, words, dim, name)
    return joined_mean_vectors(texts, keys, text, F.broadcast(words), dim, name)


def joined_mean_vectors(
    texts: DataFrame, keys: Sequence[str], text: str, words: DataFrame, dim: int, name: str = "vec",
    block_texts: int = BLOCK_TEXTS,
) -> DataFrame:
    """The means by one join per token.

    Texts are placed by their keys first, a task per ``block_texts`` texts (counted without reading them) and no fewer than the shuffle
    has: sums of a text never leave its task, and a task holds the sums of one block, whatever the input.
    One plain sum per dimension keeps the aggregate buffer flat; it is written as SQL text because
    building hundreds of Column objects costs more than the query.
    """
    parts = max(texts.count() // block_texts + 1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    joined = text_tokens(texts.repartition(parts, *keys), keys, text).join(words, "word", "left")
    sums = ", ".join(f"sum(get(vec, {i}) * weight)" for i in range(dim))
    mean = f"transform(array({sums}), s -> coalesce(s, 0D) / greatest(count(vec), 1))"
    return joined.groupBy(*keys).agg(F.expr(mean).alias(name))


def blocked_mean_vectors(
    texts: DataFrame, keys: Sequence[str], text: str, words: DataFrame, dim: int, name: str = "vec",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The means by blocks of texts, for word tables of any size.

    Texts are placed once, by a hash of their keys, in blocks of about ``block_bytes``; tokens are counted
    where they lie. The distinct words of a block fetch their weighted vectors, so a word costs one row
    per block however common it is. One task holds the counts and vectors of the few blocks that fall to
    it; a very long text counts with its different words only.
    """
    size = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0  # one number
    blocks = int(size // block_bytes) + 1
    block = F.pmod(F.xxhash64(*keys), F.lit(blocks)).alias("_block")
    dealt = texts.select(*keys, block, F.col(text).alias("_text")).repartition(blocks, "_block")
    counts = dealt.select("_block", *keys, F.explode_outer(whitespace_tokens(F.col("_text"))).alias("_word")).groupBy(
        "_block", *keys, "_word"
    ).agg(F.count(F.lit(1)).alias("_n"))
    weighted = words.where(F.col("vec").isNotNull()).select(
        F.col("word").alias("_word"),
        F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.get("vec", i) * F.col("weight"), F.lit(0.0))).alias("_vec"),
    )
    own = counts.select(F.col("_block").alias("_of"), F.col("_word").alias("_wanted")).distinct()
    wanted = own.join(weighted, F.col("_wanted") == F.col("_word")).select("_of", "_wanted", "_vec")
    schema = T.StructType([*texts.select(*keys).schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    return counts.groupBy("_block").cogroup(wanted.groupBy("_of")).applyInPandas(_block_means(list(keys), dim, name), schema)


def _block_means(keys: list[str], dim: int, name: str):
    def means(counts: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        number = counts.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        firsts = np.unique(number, return_index=True)[1]
        place = pd.Index(vectors["_wanted"]).get_indexer(counts["_word"])
        known = np.flatnonzero(place >= 0)
        known = known[np.argsort(number[known], kind="stable")]
        matrix = np.stack(vectors["_vec"].to_list()) if len(vectors) else np.zeros((0, dim))
        times = counts["_n"].to_numpy(dtype=float)
        sums = np.zeros((len(firsts), dim))
        for start in range(0, len(known), 16_384):
            some = known[start:start + 16_384]
            begins = np.flatnonzero(np.diff(number[some], prepend=-1))
            sums[number[some[begins]]] += np.add.reduceat(matrix[place[some]] * times[some, None], begins)
        total = np.bincount(number[known], weights=times[known], minlength=len(firsts))
        found = counts[keys].iloc[firsts].reset_index(drop=True)
        found[name] = list(sums / np.maximum(total, 1)[:, None])
        return found

    return means


def average_vectors(texts: DataFrame, keys: Sequence[str], text: str, words: DataFrame, dim: int) -> DataFrame:
    """Plain mean of word vectors."""
    return mean_vectors(texts, keys, text, weighted_words(words), dim)


def idf_vectors(
    texts: DataFrame, keys: Sequence[str], text: str, words: DataFrame, idf: DataFrame, dim: int
) -> DataFrame:
    """Idf-weighted mean; a word without idf weighs 0 but still counts in the divisor."""
    return mean_vectors(texts, keys, text, weighted_words(words, idf), dim)


def borrowed_vectors(words: DataFrame, auxiliary: DataFrame, decimals: int = 6) -> DataFrame:
    """(word, vec): for each unknown word of an auxiliary table the vector of the nearest known one.

    Nearest means the largest dot product, the lower word on ties. (The original took the wrong end
    of its sorted list here; this is what it was meant to do.) Pass only the auxiliary words that
    the texts use.
    """
    unknown = written(auxiliary.join(words.select("word"), "word", "left_anti").select("word", "vec"), "unknown")
    match = nearest(
        unknown, words.select(F.col("word").alias("known"), "vec"), k=1, metric="dot", question="word", item="known",
        decimals=decimals, few=unknown.count() <= FEW_QUESTIONS,
    )
    borrowed = match.select("word", "known").join(words.select(F.col("word").alias("known"), "vec"), "known")
    return borrowed.select("word", "vec")


def with_fallback(words: DataFrame, auxiliary: DataFrame, decimals: int = 6) -> DataFrame:
    """Known words plus the borrowed vectors of unknown ones."""
    return words.select("word", "vec").unionByName(borrowed_vectors(words, auxiliary, decimals))


def _every_used(texts: DataFrame, text: str, words: DataFrame, auxiliary: DataFrame) -> DataFrame:
    """Stored (word, vec) of the words that the texts use, known or borrowed: searched once, read often.

    The search is over all known words; those that no text uses have no part in the means.
    """
    used = written(text_tokens(texts, [], text).where(F.col("word").isNotNull()).distinct(), "used")
    own = words.join(used, "word", "left_semi").select("word", "vec")
    return written(own.unionByName(borrowed_vectors(words, auxiliary.join(used, "word", "left_semi"))), "every")


def average_vectors_with_fallback(
    texts: DataFrame, keys: Sequence[str], text: str, words: DataFrame, auxiliary: DataFrame, dim: int
) -> DataFrame:
    return mean_vectors(texts, keys, text, weighted_words(_every_used(texts, text, words, auxiliary)), dim)


def idf_vectors_with_fallback(
    texts: DataFrame, keys: Sequence[str], text: str, words: DataFrame, auxiliary: DataFrame, idf: DataFrame, dim: int
) -> DataFrame:
    """As above with idf weights; a missing or zero idf weighs 1."""
    every = _every_used(texts, text, words, auxiliary)
    return mean_vectors(texts, keys, text, weighted_words(every, idf, unknown=1.0, zero=1.0), dim)


def aligned_vectors(vocabulary: DataFrame, pretrained: DataFrame, dim: int) -> DataFrame:
    """Pretrained vector of each vocabulary word, or the mean of all pretrained rows."""
    means = mean_vector(pretrained, "vec", dim).scalar()
    joined = vocabulary.join(pretrained.select(F.col("word").alias("token"), "vec"), "token", "left")
    return joined.withColumn("vec", F.coalesce("vec", means))
