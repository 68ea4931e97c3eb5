"""Token sequences to padded id sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import padded
from threadloom.session import placed


def numericalised(docs: DataFrame, key: str, tokens: str, vocabulary: DataFrame, unknown: int = 0) -> DataFrame:
    """(key, ids): vocabulary number of each token in order, ``unknown`` for the rest.

    Texts are placed by key first, so putting a text together again needs no shuffle of its tokens
    as long as Spark's size check lets the vocabulary be broadcast; otherwise tokens are shuffled
    for the join, with hot tokens split by adaptive execution.
    """
    spread = placed(docs.select(key, tokens), key).select(key, F.posexplode_outer(tokens).alias("at", "token"))
    known = vocabulary.select("token", "idx")
    numbered = spread.join(known, "token", "left").select(
        key, "at", F.when(F.col("at").isNotNull(), F.coalesce("idx", F.lit(unknown))).alias("idx")
    )
    pairs = F.filter(F.sort_array(F.collect_list(F.struct("at", "idx"))), lambda p: p["at"].isNotNull())
    return numbered.groupBy(key).agg(F.transform(pairs, lambda p: p["idx"]).alias("ids"))


def padded_sequences(encoded: DataFrame, key: str, length: int, side: str = "pre", value: int = 1) -> DataFrame:
    """Sequences cut to their last ``length`` ids and filled up to it."""
    return encoded.select(key, padded(F.col("ids"), length, side, value).alias("ids"))
