"""Upkeep, grouping, metrics, splits and models on small tables."""

import math

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from suite import jobs
from threadloom.operators import aggregates as A
from threadloom.operators import maintenance as U
from threadloom.operators import metrics as M
from threadloom.operators import models as L
from threadloom.operators import rerank as W
from threadloom.operators import selection as P
from threadloom.plans.answers import answer_questions


def test_upsert_rules(spark):
    schema = "parent_id bigint, comment_id bigint, score bigint"
    old = spark.createDataFrame([(1, 10, 5), (2, 20, 1)], schema)
    new = spark.createDataFrame([(1, 11, 7), (2, 21, 1), (3, 30, 2)], schema)
    assert sorted(r["comment_id"] for r in U.upserted(old, new).collect()) == [11, 20, 30]
    assert sorted(r["comment_id"] for r in U.upserted(old, new, keep="lowest").collect()) == [10, 20, 30]


def test_acceptable(spark):
    df = spark.createDataFrame([("",), ("fine",), ("a " * 150 + "b",), ("<code>x",), ("y" * 1001,)], "c string")
    assert [r[0] for r in df.select(P.acceptable_short(F.col("c"))).collect()] == [False, True, False, False, False]
    assert [r[0] for r in df.select(P.acceptable_long(F.col("c"))).collect()] == [False, True, True, True, True]


def test_combined_answers_are_whole_and_in_order(spark):
    parents = spark.createDataFrame(
        [(1, 5, "q", "t", 1, 0.5, "x"), (2, 5, "q", "t", 1, 0.7, "x"), (1, 6, "q", None, 1, 0.5, "x"), (1, 7, "q", "t", 1, 0.5, "x")],
        "qid bigint, comment_id bigint, comment string, title string, score bigint, distances double, tags string",
    )
    answers = spark.createDataFrame(
        [(5, i, f"a{i}", i % 4) for i in range(2500)] + [(6, 9001, "z", 1), (7, 9002, None, 3), (8, 9003, "y", 1)],
        "parent_id bigint, comment_id bigint, comment string, score bigint",
    )
    got = A.combined_answers(parents, answers).orderBy("qid").collect()
    assert [(r["qid"], r["comment_id"]) for r in got] == [(1, 5), (2, 5)]
    order = sorted(range(2500), key=lambda i: (-(i % 4), i))
    assert all(r["combined_comments"] == [f"a{i}::{i % 4}" for i in order] for r in got)


def test_id_positions_are_whole(spark):
    ids = [3, 3, 9, 5000, 70_000, 70_001, 200_000]
    df = spark.createDataFrame([(1, i) for i in ids] + [(None, 4), (2, 8), (2, None)], "p bigint, c bigint")
    got = sorted(tuple(r) for r in A.id_positions(df, "p", "c", "id").collect())
    assert got == [(1, n + 1, i) for n, i in enumerate(ids)] + [(2, 1, 8)]


def test_scaling_of_constant_and_single_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 3.0), (2, 7.0), (3, 1.0), (3, 1.0)], "q int, x double")
    got = sorted((r["q"], r["x"]) for r in A.min_max_scaled(df, ["x"], "q").collect())
    assert got == [(1, 0.0), (1, 0.5), (1, 1.0), (2, 0.0), (3, 0.0), (3, 0.0)]


def test_ranking_metrics(spark):
    ranks = spark.createDataFrame([(1,), (3,), (20,)], "rank int")
    got = {r["k"]: (r["hits"], r["dcg"]) for r in M.ranking_metrics(ranks, [1, 5]).collect()}
    assert got[1] == (pytest.approx(1 / 3), pytest.approx(1 / 3))
    assert got[5] == (pytest.approx(2 / 3), pytest.approx((1 + 1 / math.log2(4)) / 3))
    assert M.ranking_metrics(ranks.where("rank < 0"), [1]).first()["dcg"] == 0.0


def test_histogram_with_closed_last_bin(spark):
    got = A.length_histogram(spark.createDataFrame([(1,), (1,), (6,), (11,)], "n int"), "n", 5).orderBy("bin").collect()
    assert [r["rows"] for r in got] == [2, 0, 1, 0, 1]


def test_vocabulary(spark):
    tokens = spark.createDataFrame([(t,) for t in "b b b a a a c c d d d d".split()], "token string")
    got = A.token_vocabulary(tokens, max_vocab=3, min_freq=2, specials=("_unk_", "_pad_")).orderBy("idx").collect()
    assert [r["token"] for r in got] == ["_unk_", "_pad_", "d", "a", "b"]


def test_splits(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 900, "hot").otherwise("cold").alias("lang"))
    split = L.stratified_split(df, "id", "lang")
    assert {(r["lang"], r["n"]) for r in split.where("is_test").groupBy("lang").agg(F.count("*").alias("n")).collect()} == {("hot", 90), ("cold", 10)}
    again = {r["id"] for r in L.stratified_split(df, "id", "lang").where("is_test").collect()}
    assert again == {r["id"] for r in split.where("is_test").collect()}
    assert 50 < L.random_split(df, "id").where("is_test").count() < 150


def test_classifier_beats_the_majority_class(spark):
    rows = [(i, ("sort list python" if i % 3 else "css html style").split() + [f"w{i % 7}"], "python" if i % 3 else "css") for i in range(120)]
    docs = spark.createDataFrame(rows, "id bigint, tokens array<string>, tag string")
    encoded, names = L.encoded_labels(docs, "tag")
    assert names == ["css", "python"]
    features = L.fit_features(encoded)
    ready = features.transform(encoded).select("id", "features", F.col("label").cast("double").alias("label"))
    model = L.fit_tag_classifier(ready, 120, iterations=10)
    scored = L.predicted_tags(L.with_probabilities(model, ready), names)
    assert M.accuracy(scored).first()[0] > 0.9
    first = scored.first()
    assert sum(first["probability"]) == pytest.approx(1.0)
    assert first["predicted"][0]["tag"] in names


def test_models_learn_from_every_training_row(spark, tmp_path):
    docs = spark.range(240_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), (F.col("id") / 3).cast("int")).alias("text"), F.lit("en").alias("lang"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ready, _, features = jobs._labelled(spark, str(tmp_path))
    train = ready.where("not is_test").join(docs.select("doc_id", "text"), "doc_id")
    assert train.count() > 200_000 and jobs._train(ready).count() == train.count()
    assert len(features.stages[0].vocabulary) == train.groupBy("text").count().where("count >= 2").count()


def test_classes_are_trained_one_by_one_over_many_terms(spark):
    sizes = {n: L._at_once(spark.createDataFrame([(Vectors.sparse(n, [0], [1.0]),)], ["features"])) for n in (10, 300_000, 3_000_000)}
    assert sizes == {10: 4, 300_000: 2, 3_000_000: 1}


def test_answer_questions_end_to_end(spark):
    posts = spark.createDataFrame(
        [(4, None, "how to sort a list", "sorting lists", 5, "python-list"), (5, 4, "use sorted", None, 3, None), (6, 4, "use sort", None, 9, None),
         (8, None, "center a div", "css centering", 2, "css"), (9, 8, "flexbox", None, 1, None), (12, None, "sort a dict", "dict order", 1, "python")],
        "comment_id bigint, parent_id bigint, comment string, title string, score bigint, tags string")
    words = spark.createDataFrame([("sort", [1.0, 0.0]), ("list", [0.8, 0.3]), ("css", [0.0, 1.0]), ("div", [0.1, 0.9])], "word string, vec array<double>")
    idf = spark.createDataFrame([("sort", 1.2), ("list", 1.5), ("css", 2.0), ("div", 2.0)], "term string, idf double")
    vectors = spark.createDataFrame([("python", 4, [0.9, 0.1]), ("css", 8, [0.0, 1.0]), ("python", 12, [1.0, 0.0])], "tag string, comment_id bigint, vec array<double>")
    asked = spark.createDataFrame(
        [(1, "How do I sort a list?", [("python", 0.6), ("css", 0.3)]), (2, "  ", [("python", 0.9)])],
        "qid bigint, question string, predicted array<struct<tag:string,score:double>>")
    got = answer_questions(asked, posts, vectors, words, idf, 2, k=5).orderBy(F.desc("final_weight")).collect()
    assert [r["comment_id"] for r in got] == [4, 8]
    assert got[0]["combined_comments"] == ["use sort::9", "use sorted::3"]
    assert (got[0]["tag_score"], got[1]["tag_score"]) == (0.6, 0.3)


def test_best_weights(spark):
    schema = "qid int, pos int, scaled_distance double, tag_score double, " + ", ".join(f"{f} double" for f in W.FEATURES)
    rows = [(q, p, 0.0 if p else 1.0, 0.0, *([1.0 if p == 0 else 0.2] * len(W.FEATURES))) for q in (1, 2) for p in range(3)]
    grid = [{"distance": 5.0, "tfidf": 0.0, "ngram": 0.0, "combo": 0.0}, {"distance": 0.0, "tfidf": 1.0, "ngram": 0.0, "combo": 0.0}]
    got = {r["setting"]: r["dcg"] for r in W.best_weights(spark.createDataFrame(rows, schema), grid, 5).collect()}
    assert got[1] == pytest.approx(1.0) and got[0] < 1.0


def test_a_vocabulary_beyond_the_driver_is_an_error(spark):
    lines = spark.createDataFrame([(["a", "b", "a", "b", "c"],)], "tokens array<string>")
    with pytest.raises(ValueError, match="2 words of 10 dimensions"):
        L.fit_word_vectors(lines, dim=10, driver_bytes=2 * 10 * 8 - 1)
    model = L.fit_word_vectors(lines, dim=10, epochs=1, parts=1, driver_bytes=2 * 10 * 8)
    assert sorted(r["word"] for r in L.word_table(model).collect()) == ["a", "b"]
