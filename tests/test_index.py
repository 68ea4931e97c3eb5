"""The stored vector index against the plain search."""

import numpy as np
import pytest

from threadloom.operators import index as X
from threadloom.operators import neighbours as N


@pytest.fixture(scope="module")
def clustered(spark):
    """Two tags of forty clusters each, many copies of one vector, a zero vector."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    rows = [(["b", "a", "a"][i % 3], i, [float(x) for x in centres[i % 40] + 0.05 * rng.normal(size=16)]) for i in range(4800)]
    rows += [("a", 20000 + i, [1.0] + [0.0] * 15) for i in range(700)] + [("b", 30000, [0.0] * 16), ("small", 1, [1.0] * 16)]
    return spark.createDataFrame(rows, "tag string, comment_id long, vec array<double>").repartition(8, "comment_id").cache()


@pytest.fixture(scope="module")
def stored(spark, clustered, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('index')}/vectors"
    X.build(clustered, path, rows=64)
    return X.load(spark, path)


@pytest.fixture(scope="module")
def asked(spark, clustered):
    odd = spark.createDataFrame([("a", 99999, [0.0] * 16), ("none", 5, [1.0] * 16), ("small", 7, [0.5] * 16)], clustered.schema)
    return clustered.where("comment_id % 97 = 0").union(odd).withColumnRenamed("comment_id", "qid")


def rows(df):
    return {tuple(r) for r in df.select("qid", "tag", "comment_id", "distances", "rank").collect()}


def test_cells_are_bounded_and_hold_every_vector(clustered, stored):
    sizes = [r["size"] for r in stored.blocks.select("size").collect()]
    assert sum(sizes) == clustered.count() and max(sizes) <= 2 * 64


@pytest.mark.parametrize("k", [1, 10, 3000])
def test_search_equals_all_pairs(clustered, stored, asked, k):
    want = rows(N.nearest(asked, clustered, k, group="tag"))
    assert rows(X.search(asked, stored, k)) == want and len(want) > 0


def test_most_cells_are_skipped_before_the_join(stored, asked):
    real = asked.where("qid < 90000")
    opened = X.open_cells(real, stored, 10).count()
    assert opened < 0.2 * real.join(stored.blocks.select("tag", "cell"), "tag").count()


def test_coded_search_reads_a_tenth_and_recalls_nine_tenths(clustered, stored, asked):
    real = asked.where("tag in ('a', 'b')")
    want = {r[:3] for r in rows(N.nearest(real, clustered, 10, group="tag"))}
    found = X.coded_search(real, stored, 10).collect()
    assert len(found) == len(want) and all(r["scored"] <= 160 for r in found)
    assert len({(r["qid"], r["tag"], r["comment_id"]) for r in found} & want) >= 0.9 * len(want)
    small = X.coded_search(asked.where("tag = 'small'"), stored, 10).collect()
    assert [(r["qid"], r["comment_id"]) for r in small] == [(7, 1)]


def test_no_vectors_of_the_store_are_gathered(stored, asked):
    plan = X._scanned(X.open_cells(asked, stored, 5), asked, stored, 5, "qid", 6)._jdf.queryExecution().optimizedPlan().toString()
    gathered = [line for line in plan.splitlines() if "collect_list" in line]
    assert gathered and all("qid" in line for line in gathered)


def test_own_rank_counts_whole_cells(spark, clustered, stored):
    probes = clustered.where("comment_id % 53 = 0 or comment_id >= 30000")
    shifted = probes.selectExpr("tag", "comment_id", "transform(vec, (x, i) -> x + 0.02 * sin(i + comment_id)) AS vec")
    want = {tuple(r) for r in N.own_rank(shifted, clustered).select("tag", "comment_id", "rank", "runner_up").collect()}
    found = X.own_rank(shifted, stored, clustered)
    assert {tuple(r)[:4] for r in found.collect()} == want
    assert found.where("tag <> 'small'").selectExpr("avg(scored)").first()[0] < 0.5 * 3900


def test_empty_tables(spark, clustered, stored, asked, tmp_path):
    assert X.search(asked.where("false"), stored, 5).count() == 0
    empty = X.build(clustered.where("false"), f"{tmp_path}/empty")
    assert X.search(asked, empty, 5).count() == 0 and X.coded_search(asked, empty, 5).count() == 0


def test_own_rank_writes_no_row_for_settled_cells(spark, clustered, stored, monkeypatch):
    kept, plain = {}, X.written
    monkeypatch.setattr(X, "written", lambda df, name: kept.setdefault(name, plain(df, name)))
    found = X.own_rank(clustered, stored, clustered)
    read = found.agg({"scored": "sum"}).first()[0]
    cells, documents = stored.blocks.groupBy("tag").count(), clustered.groupBy("tag").count()
    every = cells.withColumnRenamed("count", "c").join(documents, "tag").selectExpr("sum(c * count)").first()[0]
    judged = kept["judged"]
    assert judged.count() < every and judged.where("cell is not null").agg({"size": "sum"}).first()[0] == read
    assert judged.where("cell is null").count() == sum(r["n"] for r in stored.shelves.groupBy("tag").count().join(documents.withColumnRenamed("count", "d"), "tag").selectExpr("count * d as n").collect())


def test_a_question_meets_the_cells_of_a_bundle_at_once(stored, asked, monkeypatch):
    real = asked.where("tag in ('a', 'b') and qid < 90000")
    opened = X.open_cells(real, stored, 3000).cache()
    assert X._scanned(opened, real, stored, 5, "qid", 6).count() < opened.count()  # five rows a bundle of 16 cells
    want = rows(X.search(real, stored, 10))
    monkeypatch.setattr(X, "BUNDLE", 1)
    assert rows(X.search(real, stored, 10)) == want
