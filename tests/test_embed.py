"""Text vectors by blocks beside the plain join and plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import embed as E

WORDS = [f"w{i}" for i in range(300)]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    vectors = {w: [rng.uniform(-1, 1) for _ in range(5)] for w in WORDS[:200]}
    texts = [(i % 40, f"k{i}", " ".join(rng.choice(WORDS[: 1 + rng.randrange(300)]) for _ in range(rng.randrange(30)))) for i in range(200)]
    texts += [(None, "n", "w1 w1 w2"), (1, None, "w3"), (7, "blank", ""), (8, "null", None), (9, "none", "zz yy"), (1, "long", "w5 w6 " * 30_000)]
    weights = {w: rng.uniform(0, 3) for w in WORDS[:200]}
    words = spark.createDataFrame([(w, v, weights[w]) for w, v in vectors.items()], "word string, vec array<double>, weight double")
    return vectors, weights, texts, words, spark.createDataFrame(texts, "a long, b string, text string")


def expected(vectors, weights, texts):
    means = {}
    for a, b, text in texts:
        hits = [w for w in (text or "").split() if w in vectors]
        means[a, b] = [sum(vectors[w][i] * weights[w] for w in hits) / max(len(hits), 1) for i in range(5)]
    return means


@pytest.mark.parametrize("block_bytes", [500, 8 << 20])
def test_blocks_are_the_means(spark, tables, block_bytes):
    vectors, weights, texts, words, df = tables
    found = {(r["a"], r["b"]): r["vec"] for r in E.blocked_mean_vectors(df, ["a", "b"], "text", words, 5, block_bytes=block_bytes).collect()}
    known = expected(vectors, weights, texts)
    assert found.keys() == known.keys()
    assert all(found[k] == pytest.approx(known[k], abs=1e-9) for k in known)


def test_the_size_of_the_word_table_chooses(spark, tables):
    *_, words, df = tables
    small = E.mean_vectors(df, ["a", "b"], "text", words, 5)
    large = E.mean_vectors(df, ["a", "b"], "text", words, 5, broadcast_bytes=100)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in large._jdf.queryExecution().executedPlan().toString()
    rounded = lambda d: sorted(map(repr, d.select("a", "b", F.transform("vec", lambda x: F.round(x, 9) + 0.0).alias("v")).collect()))
    assert rounded(small) == rounded(large)


def test_clashing_names_and_no_rows(spark, tables):
    *_, words, df = tables
    odd = df.select(F.col("a").alias("word"), F.col("b").alias("n"), "text")
    assert E.blocked_mean_vectors(odd, ["word", "n"], "text", words, 5).count() == 206
    assert E.blocked_mean_vectors(df.where("a < 0"), ["a"], "text", words, 5).count() == 0
    none = E.blocked_mean_vectors(df, ["a", "b"], "text", words.where("weight < 0"), 5)
    assert {tuple(r["vec"]) for r in none.collect()} == {(0.0,) * 5}


def test_tasks_grow_in_number_with_the_texts(spark, tables):
    *_, words, _ = tables

    def tasks(texts):
        rows = spark.createDataFrame([(i, "w1 w2 " * 50) for i in range(texts)], "a long, text string")
        return E.joined_mean_vectors(rows, ["a"], "text", F.broadcast(words), 5, block_texts=10).rdd.getNumPartitions()

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert tasks(10) == 8 and tasks(400) == 41
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_candidates_meet_questions_in_bounded_partitions(spark, tables, monkeypatch):
    from threadloom.plans import answers as Q

    vectors, weights, _, words, _ = tables
    cases = spark.createDataFrame([(q, "w1 w2", ["w1 w2", "w3", ""]) for q in range(100)], "qid long, question string, cands array<string>")
    monkeypatch.setattr(Q, "JOINED_ROWS", 10, raising=False)
    scores = Q.candidate_scores(cases, lambda df, keys, column: E.mean_vectors(df, keys, column, words, 5))
    assert "hashpartitioning(qid#" in scores._jdf.queryExecution().executedPlan().toString() and scores.rdd.getNumPartitions() == 31
    found = {(r["qid"], r["pos"]): r["score"] for r in scores.collect()}
    assert len(found) == 300 and found[7, 0] == pytest.approx(1.0) and found[7, 2] == 0.0


def test_borrowed_vectors_are_searched_once(spark, tables, monkeypatch):
    vectors, _, _, words, df = tables
    spare = spark.createDataFrame([("zz", [1.0, 0.0, 0.0, 0.0, 0.0]), ("unused", [0.0] * 5)], "word string, vec array<double>")
    runs, plain = spark.sparkContext.accumulator(0), E.nearest

    def counted(asked, stored, **settings):
        touched = F.udf(lambda w: runs.add(1) or w, "string").asNondeterministic()
        return plain(asked.withColumn("word", touched("word")), stored, **settings)

    monkeypatch.setattr(E, "nearest", counted)
    found = E.average_vectors_with_fallback(df, ["a", "b"], "text", words.select("word", "vec"), spare, 5)
    got = {(r["a"], r["b"]): r["vec"] for r in found.collect()}
    near = max(vectors, key=lambda w: round(vectors[w][0], 6))
    assert got[9, "none"] == pytest.approx(vectors[near]) and runs.value == 1


def test_fallback_stores_used_words_only(spark, tables, monkeypatch):
    vectors, _, _, words, _ = tables
    spare = spark.createDataFrame([("zz", [1.0, 0.0, 0.0, 0.0, 0.0]), ("unused", [0.0] * 5)], "word string, vec array<double>")
    kept, plain = {}, E.written
    monkeypatch.setattr(E, "written", lambda df, name: kept.setdefault(name, plain(df, name)))
    texts = spark.createDataFrame([(1, "w1 w2 zz"), (2, "nothing known")], "a long, text string")
    found = {r["a"]: r["vec"] for r in E.average_vectors_with_fallback(texts, ["a"], "text", words.select("word", "vec"), spare, 5).collect()}
    assert {r["word"] for r in kept["every"].collect()} == {"w1", "w2", "zz"}
    near = max(vectors, key=lambda w: round(vectors[w][0], 6))
    assert found == {1: pytest.approx([sum(x) / 3 for x in zip(vectors["w1"], vectors["w2"], vectors[near])]), 2: [0.0] * 5}


@pytest.mark.parametrize("few", [True, False])
def test_repeated_blocks_are_not_broadcast(spark, few):
    from threadloom.operators import neighbours as N

    asked = spark.range(9).selectExpr("id AS qid", "array(cos(id), sin(id)) AS vec")
    stored = spark.range(3000).selectExpr("id AS comment_id", "array(cos(id * 7), sin(id * 7)) AS vec")
    found = N.nearest(asked, stored, 1, "dot", few=few)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert few == ("strategy=broadcast" in plan) and few != ("strategy=merge" in plan)
    want = {q: max(range(3000), key=lambda i: (round(math.cos(q) * math.cos(7 * i) + math.sin(q) * math.sin(7 * i), 6), -i)) for q in range(9)}
    assert {r["qid"]: r["comment_id"] for r in found.collect()} == want


def test_least_columns():
    import numpy as np

    from threadloom.operators.neighbours import _least

    values, ids = np.array([[2.0, 1.0, 1.0], [0.0, 0.0, 3.0]]), np.array([7, 9, 4])
    assert _least(values, ids, 1).tolist() == [[2], [0]] and _least(values, ids, 2).tolist() == [[2, 1], [0, 1]]


def test_blocks_bound_the_text_of_a_task(spark, tables):
    *_, words, _ = tables
    texts = spark.range(600).select(F.col("id").alias("a"), F.repeat(F.lit("w1 zz "), 1700).alias("text"))  # 6 MB
    blocks = E.blocked_mean_vectors(texts, ["a"], "text", words, 5)
    assert " 3)" in [line for line in blocks._jdf.queryExecution().optimizedPlan().toString().splitlines() if "pmod" in line][0]
    assert blocks.count() == 600


def test_texts_are_worked_out_once_where_the_word_table_is_large(spark):
    worked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def cleaned(value):
        worked.add(1)
        return value.lower()

    texts = spark.createDataFrame([(i, f"A b W{i % 7}") for i in range(300)], "a long, raw string").select("a", cleaned.asNondeterministic()("raw").alias("text"))
    words = E.weighted_words(spark.createDataFrame([(w, [1.0, float(i)]) for i, w in enumerate(["a", "b", "w3"])], "word string, vec array<double>"))
    found = {r["a"]: r["vec"] for r in E.mean_vectors(texts, ["a"], "text", words, 2, broadcast_bytes=0).collect()}
    assert len(found) == 300 and found[3] == [1.0, 1.0] and found[4] == [1.0, 0.5]
    assert worked.value == 300
