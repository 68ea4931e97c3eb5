"""Jobs that answer and evaluate whole tables of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import constants as C
from threadloom.functions.text import search_text
from threadloom.functions.vectors import cosine
from threadloom.operators import index as stored_index
from threadloom.operators.aggregates import combined_answers
from threadloom.operators.embed import mean_vectors, weighted_words
from threadloom.operators.metrics import ranking_metrics
from threadloom.operators.neighbours import nearest
from threadloom.operators.ranking import rank_of_first, weight_rank
from threadloom.operators.rerank import all_features, weighed
from threadloom.operators.selection import askable
from threadloom.session import placed, written
from threadloom.sources.models import TagModel


#: (questions with tag and vector, stored vectors, k) to (qid, tag, comment_id, distances).
Search = Callable[[DataFrame, DataFrame, int], DataFrame]


def thread_vectors(posts: DataFrame, text: str, tag: Column, words: DataFrame, idf: DataFrame, dim: int) -> DataFrame:
    """(tag, comment_id, vec) of every question post: the table the search runs on."""
    asked = posts.where(F.col("parent_id").isNull())
    cleaned = asked.select(tag.alias("tag"), "comment_id", search_text(F.col(text)).alias("text"))
    return mean_vectors(cleaned, ["tag", "comment_id"], "text", weighted_words(words, idf), dim)


def found_answers(neighbours: DataFrame, posts: DataFrame) -> DataFrame:
    """Found posts with title, body, tags and all their answers: one row per question and post.

    The least distance per (question, post) is the list of found posts, so the search runs once.
    """
    near = neighbours.groupBy("qid", "comment_id").agg(F.min("distances").alias("distances"))
    return combined_answers(near.join(posts, "comment_id"), posts.where(F.col("parent_id").isNotNull()))


def question_vectors(questions: DataFrame, words: DataFrame, idf: DataFrame, dim: int) -> DataFrame:
    """Vector of each question text, on the search form."""
    cleaned = questions.select("qid", search_text(F.col("question")).alias("question"))
    return mean_vectors(cleaned, ["qid"], "question", weighted_words(words, idf), dim)


def exact_search(metric: str = "angular") -> Search:
    """The search of ``answer_questions`` over all vectors of the asked tags."""
    return lambda asked, vectors, k: nearest(asked, vectors, k, metric, group="tag")


def index_search(index: stored_index.VectorIndex, coded: bool = False) -> Search:
    """The search of ``answer_questions`` in a stored index, whose vectors need not be given again.

    Exact by the bounds of its cells, or with ``coded`` by codes and a few vectors.
    """
    look = stored_index.coded_search if coded else stored_index.search
    return lambda asked, vectors, k: look(asked, index, k).drop("scored")


def answer_questions(
    questions: DataFrame, posts: DataFrame, vectors: DataFrame | None, words: DataFrame, idf: DataFrame, dim: int,
    k: int = C.TOP_NEIGHBOURS, metric: str = "angular", search: Search | None = None,
) -> DataFrame:
    """Ranked answers to every question, best weight first; ``rank`` counts from 1 per question.

    ``questions`` is (qid, question, predicted) with ``predicted`` an array of (tag, score) from the
    classifier. Only the vectors of those tags are searched, by ``search``: exactly if none is given,
    or for instance by ``approximate_nearest`` or ``index_search``. The found candidates are written once,
    since every feature reads them again.
    """
    questions = askable(questions)
    asked = question_vectors(questions, words, idf, dim)
    tags = questions.select("qid", F.explode("predicted.tag").alias("tag"))
    neighbours = (search or exact_search(metric))(asked.join(tags, "qid"), vectors, k)
    found = written(found_answers(neighbours, posts), "candidates")
    cleaned = questions.select("qid", search_text(F.col("question")).alias("question"), "predicted")
    ranked = weight_rank(weighed(all_features(found.drop("combined_comments"), cleaned), cleaned))
    return ranked.join(found.select("qid", "comment_id", "combined_comments"), ["qid", "comment_id"])


def answer_raw_questions(
    questions: DataFrame, model: TagModel, posts: DataFrame, vectors: DataFrame | None, words: DataFrame,
    idf: DataFrame, dim: int, k: int = C.TOP_NEIGHBOURS, metric: str = "angular", search: Search | None = None,
) -> DataFrame:
    """Question texts in, ranked answers out: the (stored) model predicts the tags that are searched.

    Predictions are written once: vectors, search and tag confidence all read them. ``vectors`` may be
    None if ``search`` has its own.
    """
    predicted = written(model.predict(askable(questions)).select("qid", "question", "predicted"), "predicted")
    return answer_questions(predicted, posts, vectors, words, idf, dim, k, metric, search)


def answer_topic_questions(
    questions: DataFrame, posts: DataFrame, vectors: DataFrame | None, words: DataFrame, idf: DataFrame, dim: int,
    k: int = C.TOP_NEIGHBOURS, metric: str = "angular", search: Search | None = None,
) -> DataFrame:
    """The single-topic search: ``questions`` is (qid, question, tag); no classifier, no re-rank."""
    questions = askable(questions)
    asked = question_vectors(questions, words, idf, dim)
    neighbours = (search or exact_search(metric))(asked.join(questions.select("qid", "tag"), "qid"), vectors, k)
    return found_answers(neighbours, posts)


#: Candidates per partition where their vectors are joined with those of the questions.
JOINED_ROWS = 32_768

Vectoriser = Callable[[DataFrame, list[str], str], DataFrame]


def candidate_scores(
    cases: DataFrame, vectorise: Vectoriser, clean: Callable[[Column], Column] | None = None, decimals: int = 6
) -> DataFrame:
    """(qid, pos, score): cosine of each candidate and its question.

    ``cases`` is (qid, question, cands array); ``vectorise(texts, keys, column)`` is any of the text
    vector functions with its tables bound; ``clean`` is applied to each text first. Candidates are
    placed one by one before they are cleaned, so the many of one question spread out. Vectors meet in
    partitions of about ``JOINED_ROWS`` candidates, so a task sorts as many of them whatever the input.
    """
    clean = clean or (lambda text: text)
    asked = cases.select("qid", clean(F.col("question")).alias("question"))
    spread = placed(cases.select("qid", F.posexplode("cands").alias("pos", "cand")), "qid", "pos")
    offered = vectorise(spread.select("qid", "pos", clean(F.col("cand")).alias("cand")), ["qid", "pos"], "cand")
    rows = cases.agg(F.sum(F.greatest(F.size("cands"), F.lit(0)).cast("bigint"))).first()[0] or 0  # one number
    parts = max(int(rows // JOINED_ROWS) + 1, int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    theirs = vectorise(asked, ["qid"], "question").withColumnRenamed("vec", "q_vec")
    pairs = offered.repartition(parts, "qid").join(theirs.repartition(parts, "qid"), "qid")
    return pairs.select("qid", "pos", F.round(cosine(F.col("q_vec"), F.col("vec")), decimals).alias("score"))


def evaluate_ranking(
    cases: DataFrame, vectorise: Vectoriser, depths=C.EVALUATION_DEPTHS, clean: Callable[[Column], Column] | None = None
) -> DataFrame:
    """(k, hits, dcg) of the true candidate (position 0) over all cases."""
    return ranking_metrics(rank_of_first(candidate_scores(cases, vectorise, clean)), depths)
