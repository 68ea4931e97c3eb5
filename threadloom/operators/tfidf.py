"""Term weights: idf = ln((1 + n) / (1 + df)) + 1, rows scaled to unit length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import constants as C
from threadloom.functions.text import whitespace_tokens
from threadloom.operators.ranking import top_k
from threadloom.session import placed, written

#: Postings of one term that are joined in one task.
POSTINGS = 1 << 16


def idf_of(df: Column, n: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def term_idf(
    docs: DataFrame, text: str, min_df: int = 2, max_share: float = C.MAX_DOC_SHARE
) -> DataFrame:
    """(term, df, idf) of the terms found in at least ``min_df`` texts and at most ``max_share`` of them.

    Terms are made distinct inside each row, so document frequency is a plain count that combines
    on the map side.
    """
    n = docs.select(F.count(F.lit(1)).alias("n")).scalar()
    terms = docs.select(F.explode(F.array_distinct(whitespace_tokens(F.col(text)))).alias("term"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    kept = df.where((F.col("df") >= min_df) & (F.col("df") <= max_share * n))
    return kept.withColumn("idf", idf_of(F.col("df"), n))


def term_weights(docs: DataFrame, keys: Sequence[str], text: str, idf: DataFrame) -> DataFrame:
    """(keys, term, weight): term count times idf, unit length per text.

    Texts are partitioned by key before they are taken apart, so counting terms and summing squares
    both find their rows in place.
    """
    tokens = placed(docs.select(*keys, text), *keys).select(*keys, F.explode(whitespace_tokens(F.col(text))).alias("term"))
    counts = tokens.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    weighted = counts.join(idf, "term").select(*keys, "term", (F.col("tf") * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))  # the terms of one text
    return weighted.select(*keys, "term", (F.col("w") / length).alias("weight"))


def term_similarity(asked: DataFrame, stored: DataFrame, question: str = "qid", item: str = "comment_id") -> DataFrame:
    """Dot product of question and document weights; pairs without a common term do not occur."""
    left = asked.select(question, "term", F.col("weight").alias("wq"))
    right = stored.select(item, "term", F.col("weight").alias("wd"))
    return left.join(right, "term").groupBy(question, item).agg(F.sum(F.col("wq") * F.col("wd")).alias("score"))


def term_maxima(stored: DataFrame) -> DataFrame:
    """(term, most, texts, slices): the largest weight of each term, its texts and the slices they are dealt over."""
    counted = stored.groupBy("term").agg(F.max("weight").alias("most"), F.count(F.lit(1)).alias("texts"))
    return counted.withColumn("slices", F.ceil(F.col("texts") / POSTINGS))


def _scores(pairs: DataFrame, asked: DataFrame, stored: DataFrame, question: str, item: str, decimals: int) -> DataFrame:
    """(question, item, score) of the given pairs only: their documents' weights of the question's terms."""
    wanted = pairs.select(question, item).join(asked.select(question, "term", F.col("weight").alias("wq")), question)
    met = wanted.join(stored.select(item, "term", F.col("weight").alias("wd")), [item, "term"])
    return met.groupBy(question, item).agg(F.round(F.sum(F.col("wq") * F.col("wd")), decimals).alias("score"))


def score_bounds(asked: DataFrame, stored: DataFrame, k: int, question: str = "qid", item: str = "comment_id", decimals: int = 6) -> DataFrame:
    """(question, term, weight, slices, rest, length, needed): the terms of which a document among the ``k`` best has one.

    The ``k`` heaviest documents of every term of a question are scored; the k-th best of them is a
    score that the answer reaches (0 if there are fewer). The most frequent terms that together stay
    below it are left out. What they can add is bounded twice: ``rest`` is the sum of their largest
    parts, and as documents have unit length it is at most ``length``, that of the question's weights
    left out, times what remains of the document's length.
    """
    asked_terms = asked.select("term").distinct()
    postings = stored.join(asked_terms, "term", "left_semi").select("term", item, "weight")
    heaviest = top_k(postings, ["term"], [F.desc("weight"), F.asc(item)], k, "_at").select("term", item)
    tried = asked.join(heaviest, "term").select(question, item).distinct()
    reached = top_k(_scores(tried, asked, stored, question, item, decimals), [question], [F.desc("score"), F.asc(item)], k)
    needed = reached.where(F.col("rank") == k).select(question, F.col("score").alias("needed"))
    parts = asked.join(term_maxima(postings), "term").withColumn("_part", F.col("weight") * F.col("most"))
    rarer = Window.partitionBy(question).orderBy(F.desc("texts"), "term").rowsBetween(Window.unboundedPreceding, 0)  # the terms of one text
    sums = [F.sum("_part").over(rarer).alias("_sum"), F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(rarer)).alias("_length")]
    summed = parts.select("*", *sums).join(needed, question, "left").withColumn("needed", F.coalesce("needed", F.lit(0.0)))
    out = F.least("_sum", "_length") < F.col("needed") - 10.0**-decimals
    left = [F.max(F.when(out, F.col(c)).otherwise(0.0)).over(Window.partitionBy(question)).alias(n) for c, n in (("_sum", "rest"), ("_length", "length"))]
    return summed.select("*", *left).where(~out).select(question, "term", "weight", "slices", "rest", "length", "needed")


def candidates(bounds: DataFrame, stored: DataFrame, question: str = "qid", item: str = "comment_id", decimals: int = 6) -> DataFrame:
    """(question, item, part) that may be among the best: the ``part`` they share of the bounding terms, and what the others can add, reaches ``needed``.

    The postings of a frequent term are dealt over its slices by document, so no join key is hot.
    """
    slices = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("_slice")
    asked = bounds.select(question, "term", F.col("weight").alias("wq"), "rest", "length", "needed", "slices", slices)
    sliced = F.pmod(F.xxhash64(F.col(item).cast("string")), F.col("slices")).alias("_slice")
    wanted = bounds.groupBy("term").agg(F.max("slices").alias("slices"))
    postings = stored.join(wanted, "term").select("term", item, F.col("weight").alias("wd"), sliced)
    met = asked.drop("slices").join(postings, ["term", "_slice"])
    bound = [F.max(c).alias(c) for c in ("rest", "length", "needed")]
    sums = met.groupBy(question, item).agg(F.sum(F.col("wq") * F.col("wd")).alias("part"), F.sum(F.col("wd") * F.col("wd")).alias("used"), *bound)
    more = F.least(F.col("rest"), F.col("length") * F.sqrt(F.greatest(1 - F.col("used"), F.lit(0.0))))
    return sums.where(F.col("part") + more >= F.col("needed") - 10.0**-decimals).select(question, item, "part")


def most_similar(
    asked: DataFrame, stored: DataFrame, k: int, question: str = "qid", item: str = "comment_id", decimals: int = 6
) -> DataFrame:
    """The ``k`` documents most similar to each question, of those that share a term.

    Documents that cannot reach the k-th score never meet the question. ``asked`` and ``stored`` are
    term weights (``term_weights``); both are read several times, so they should be stored tables.
    """
    bounds = written(score_bounds(asked, stored, k, question, item, decimals), "bounds")
    found = written(candidates(bounds, stored, question, item, decimals), "candidates")
    left = asked.join(bounds, [question, "term"], "left_anti").select(question, "term", F.col("weight").alias("wq"))
    others = found.join(left, question).join(stored.select(item, "term", F.col("weight").alias("wd")), [item, "term"])
    parts = found.unionByName(others.select(question, item, (F.col("wq") * F.col("wd")).alias("part")))
    scored = parts.groupBy(question, item).agg(F.round(F.sum("part"), decimals).alias("score"))
    return top_k(scored, [question], [F.desc("score"), F.asc(item)], k)
