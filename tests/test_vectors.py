"""Text vectors, neighbours, ranks and features against brute force."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import embed as E
from threadloom.operators import neighbours as N
from threadloom.operators import ranking as R
from threadloom.operators import rerank as W

WORDS = {"code": [1.0, 0.0, 2.0, 0.5], "word": [0.5, 1.0, -1.0, 2.0], "cool": [1.0, 2.0, 3.0, 4.0], "beans": [3.0, 0.0, 1.0, -2.0]}
IDF = {"word": 2.0, "cool": 1.5}


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame(list(WORDS.items()), "word string, vec array<double>").cache()


@pytest.fixture(scope="module")
def idf(spark):
    return spark.createDataFrame(list(IDF.items()), "term string, idf double").cache()


TEXTS = ["", "thereisnosuchword", "word", "Cool Beans", "thereisnosuchword word"]


def vectors(df):
    return {r["i"]: r["vec"] for r in df.collect()}


def test_average_vector_properties(spark, words):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = vectors(E.average_vectors(texts, ["i"], "t", words, 4))
    assert got[0] == got[1] == [0.0] * 4
    assert got[2] == got[4] == WORDS["word"]
    assert got[3] == pytest.approx(np.mean([WORDS["cool"], WORDS["beans"]], axis=0))


def test_idf_vector_properties(spark, words, idf):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = vectors(E.idf_vectors(texts, ["i"], "t", words, idf, 4))
    assert got[0] == got[1] == [0.0] * 4
    assert got[2] == got[4] == pytest.approx(np.array(WORDS["word"]) * 2.0)
    assert got[3] == pytest.approx(np.array(WORDS["cool"]) * 1.5 / 2)


def test_fallback_takes_the_nearest_known_word(spark, words, idf):
    spare = spark.createDataFrame([("kewl", [1.0, 2.0, 2.0, 4.0]), ("cool", [9.0] * 4)], "word string, vec array<double>")
    texts = spark.createDataFrame([(0, "kewl word"), (1, "nothing")], "i int, t string")
    plain = vectors(E.average_vectors_with_fallback(texts, ["i"], "t", words, spare, 4))
    assert plain[0] == pytest.approx(np.mean([WORDS["cool"], WORDS["word"]], axis=0))
    assert plain[1] == [0.0] * 4
    weighted = vectors(E.idf_vectors_with_fallback(texts, ["i"], "t", words, spare, idf, 4))
    assert weighted[0] == pytest.approx((np.array(WORDS["cool"]) + 2 * np.array(WORDS["word"])) / 2)


def test_aligned_vectors(spark, words):
    vocabulary = spark.createDataFrame([("code", 0), ("zzz", 1)], "token string, idx int")
    got = {r["token"]: r["vec"] for r in E.aligned_vectors(vocabulary, words, 4).collect()}
    assert got["code"] == WORDS["code"]
    assert got["zzz"] == pytest.approx(np.mean(list(WORDS.values()), axis=0))


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), "hot" if i % 3 else "cold", [float(x) for x in rng.normal(size=6)]) for i in range(1200)]
    rows[7] = (7, "hot", [0.0] * 6)
    return rows


METRICS = {
    "angular": lambda a, b: math.sqrt(max(0, 2 * (1 - (a @ b / n if (n := np.linalg.norm(a) * np.linalg.norm(b)) else 0)))),
    "euclidean": lambda a, b: np.linalg.norm(a - b),
    "manhattan": lambda a, b: np.abs(a - b).sum(),
    "hamming": lambda a, b: float(((a > 0.5) != (b > 0.5)).sum()),
    "dot": lambda a, b: a @ b,
}


@pytest.mark.parametrize("metric", METRICS)
def test_nearest_matches_brute_force(spark, points, metric):
    stored = spark.createDataFrame(points, "comment_id bigint, tag string, vec array<double>")
    asked = [(i, t, v) for i, t, v in points if i % 150 == 7]
    got = N.nearest(spark.createDataFrame(asked, "qid bigint, tag string, vec array<double>"), stored, 4, metric, group="tag")
    got = sorted((r["qid"], r["rank"], r["comment_id"]) for r in got.collect())
    sign = -1 if metric == "dot" else 1
    want = []
    for qid, tag, vec in asked:
        near = sorted((sign * round(METRICS[metric](np.array(vec), np.array(v)), 6), i) for i, t, v in points if t == tag)
        want += [(qid, r + 1, i) for r, (_, i) in enumerate(near[:4])]
    assert got == sorted(want)


def test_own_rank_matches_brute_force(spark, points):
    rng = np.random.default_rng(6)
    probes = [(i, t, [float(x + y) for x, y in zip(v, rng.normal(size=6))]) for i, t, v in points[:300]]
    schema = "comment_id bigint, tag string, vec array<double>"
    got = {r["comment_id"]: (r["rank"], r["runner_up"]) for r in N.own_rank(spark.createDataFrame(probes, schema), spark.createDataFrame(points, schema)).collect()}

    def cos(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(np.dot(a, b) / n), 6) if n else 0.0

    for i, tag, vec in probes[::25]:
        order = sorted((-cos(vec, v), j) for j, t, v in points if t == tag)
        place = [j for _, j in order].index(i) + 1
        other = next(j for _, j in order if j != i)
        assert got[i] == (place, other)


@pytest.mark.parametrize("dim", [64, 300])
def test_approximate_neighbours_recall(spark, dim):
    rng = np.random.default_rng(dim)
    middles = rng.normal(size=(12, dim))
    points = [(i, "ab"[i % 2], (middles[i % 12] + rng.normal(size=dim)).tolist()) for i in range(900)] + [(5000, "c", [1.0] * dim), (5001, "c", [0.0] * dim)]
    stored = spark.createDataFrame(points, "comment_id bigint, tag string, vec array<double>")
    asked = spark.createDataFrame([p for p in points if p[0] % 50 < 2], "qid bigint, tag string, vec array<double>")
    exact = {(r["qid"], r["comment_id"]) for r in N.nearest(asked, stored, 6, group="tag").collect() if r["qid"] != r["comment_id"]}
    found = [(r["qid"], r["comment_id"]) for r in N.approximate_nearest(asked, stored, 6).collect()]
    sizes = collections.Counter(q for q, _ in found)
    assert all(n == (2 if q >= 5000 else 6) for q, n in sizes.items()) and len(sizes) == asked.count()
    assert len(exact & set(found)) / len(exact) >= 0.8


def test_full_rank_with_a_hot_key(spark):
    rows = [(1 if i % 3 else 2, i * 7919 % 50, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "qid int, score int, pos int")
    got = {(r["qid"], r["pos"]): r["rank"] for r in R.ranked_candidates(df).collect()}
    for key in (1, 2):
        order = sorted((-s, p) for k, s, p in rows if k == key)
        assert all(got[(key, p)] == i + 1 for i, (_, p) in enumerate(order))


def test_first_candidate_leads_on_ties(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (1, 2, 0.7), (2, 0, 0.9), (2, 1, 0.9)], "qid int, pos int, score double")
    assert {r["qid"]: r["rank"] for r in R.rank_of_first(df).collect()} == {1: 2, 2: 1}


def test_confident_tags(spark):
    schema = "p array<struct<score:double,index:int,tag:string>>"
    rows = [([(0.1, 0, "a"), (0.85, 1, "b"), (0.05, 2, "c")],), ([(0.4, 0, "a"), (0.4, 1, "b"), (0.15, 2, "c"), (0.05, 3, "d")],), ([(0.8, 0, "a"), (0.2, 1, "b")],)]
    got = [[t["tag"] for t in r[0]] for r in spark.createDataFrame(rows, schema).select(R.confident_tags(F.col("p"))).collect()]
    assert got == [["b"], ["b", "a", "c"], ["a", "b"]]


# --- features -------------------------------------------------------------------------------------

def brute_features(texts, question, components):
    """Fitted term weights, gram counts and PCA products with plain numpy."""
    def grams(s):
        s = s.lower()
        return [s[i:i + n] for n in range(1, 6) for i in range(len(s) - n + 1)]

    def counts(parts, vocabulary):
        m = np.zeros((len(parts), len(vocabulary)))
        for i, p in enumerate(parts):
            for t in p:
                if t in vocabulary:
                    m[i, vocabulary[t]] += 1
        return m

    def vocabulary(parts, share):
        df = {}
        for p in parts:
            for t in set(p):
                df[t] = df.get(t, 0) + 1
        kept = sorted(t for t, d in df.items() if d <= share * len(parts))
        return {t: i for i, t in enumerate(kept)}, np.array([df[t] for t in kept], dtype=float)

    def unit(m):
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, length, out=np.zeros_like(m), where=length > 0)

    def product(x, q):
        mean = x.mean(0)
        _, _, v = np.linalg.svd(x - mean, full_matrices=False)
        v = v[:components]
        return ((x - mean) @ v.T) @ (v @ (q - mean))

    words = [t.lower().split() for t in texts]
    voc, df = vocabulary(words, 0.9)
    idf = np.log((1 + len(texts)) / (1 + df)) + 1
    tx, tq = unit(counts(words, voc) * idf), unit(counts([question.lower().split()], voc) * idf)[0]
    every, _ = vocabulary([grams(t) for t in texts], 1.0)
    rare, _ = vocabulary([grams(t) for t in texts], 0.9)
    gx, gq = counts([grams(t) for t in texts], every), counts([grams(question)], every)[0]
    rx, rq = counts([grams(t) for t in texts], rare), counts([grams(question)], rare)[0]
    return tx @ tq, product(gx, gq), product(np.hstack([tx, rx]), np.concatenate([tq, rq]))


def check_features(spark, sets, components):
    rows = [(q, i, t) for q, (texts, _) in sets.items() for i, t in enumerate(texts)]
    found = spark.createDataFrame(rows, "qid bigint, comment_id bigint, title string")
    asked = spark.createDataFrame([(q, question) for q, (_, question) in sets.items()], "qid bigint, question string")
    got = {(r["qid"], r["comment_id"]): r for r in W.text_features(found, asked, "title", components).collect()}
    assert len(got) == len(rows)
    for q, (texts, question) in sets.items():
        tfidf, ngram, combo = brute_features(texts, question, components)
        for i in range(len(texts)):
            r = got[(q, i)]
            assert r["tfidf_title"] == pytest.approx(tfidf[i], abs=1e-9)
            assert r["ngram_title"] == pytest.approx(ngram[i], abs=1e-6)
            assert r["combo_title"] == pytest.approx(combo[i], abs=1e-6)


def test_features_match_brute_force(spark):
    sets = {
        1: (["sort a list", "sort a dict by value", "how to sort", "read a file"], "sort list quickly"),
        2: (["only one text"], "only one"),
        3: (["same text", "same text", "same text"], "same"),
    }
    check_features(spark, sets, 50)


def test_features_with_more_candidates_than_directions(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["sort", "list", "dict", "file", "open", "array", "join", "merge", "text", "map"]
    many = [" ".join(rng.choice(vocabulary, size=5)) + f" {i}" for i in range(14)]
    check_features(spark, {1: (many, "sort the list"), 2: (many[:4], "open file")}, 6)


def test_features_are_counted_in_one_task_or_in_rows_alike(spark, monkeypatch):
    rng = np.random.default_rng(5)
    letters = list("aB é\U0001f600ß  \t")
    sets = [(q, i, "".join(rng.choice(letters, size=rng.integers(0, 60))) if (q + i) % 7 else None) for q in range(12) for i in range(rng.integers(1, 9))]
    found = spark.createDataFrame(sets, "qid bigint, comment_id bigint, title string")
    found = found.unionByName(found.where("qid = 3"))  # rows of one candidate count together
    asked = spark.createDataFrame([(q, "".join(rng.choice(letters, size=20))) for q in range(1, 13)], "qid bigint, question string")

    def values(**limits):
        return sorted((r["qid"], r["comment_id"], *[pytest.approx(v, abs=1e-9) for v in r[2:]]) for r in W.text_features(found, asked, "title", **limits).collect())

    in_rows = [tuple(getattr(v, "expected", v) for v in r) for r in values(text_bytes=-1)]
    assert len(in_rows) == found.count()
    mixed = values(text_bytes=200)
    monkeypatch.setattr(W, "_counted_in_rows", None)  # the texts of every question fit one task: no row per gram
    assert in_rows == values() == [tuple(getattr(v, "expected", v) for v in r) for r in mixed]


def test_features_of_a_question_are_worked_out_once(spark):
    worked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def raised(value):
        worked.add(1)
        return value

    rows = [(q, i, f"sort a list {i} of {q}") for q in range(5) for i in range(4)]
    found = spark.createDataFrame(rows, "qid bigint, comment_id bigint, raw string")
    asked = spark.createDataFrame([(q, "sort list") for q in range(5)], "qid bigint, question string")
    features = W.text_features(found.select("qid", "comment_id", raised.asNondeterministic()("raw").alias("title")), asked, "title")
    before = worked.value
    assert features.count() == features.agg(F.count("ngram_title")).first()[0] == 20
    assert features.join(features.groupBy("qid").agg(F.max("combo_title")), "qid").count() == 20
    assert worked.value == before
