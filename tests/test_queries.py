"""Registered queries beside their SQL twins on the smallest driver tables.

By default every seventh query with a twin; THREADLOOM_ALL=1 runs all of them.
"""

import os

import duckdb
import pytest

from suite.all import ORACLES, QUERIES
from suite.compare import TABLES, canonical

SF = "/root/testdata/sf0.001"
NAMES = sorted(ORACLES) if os.environ.get("THREADLOOM_ALL") else sorted(ORACLES)[::7]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_twin(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, cursor.fetchall())


def test_document_vectors_are_trained_in_full(spark, monkeypatch):
    from suite import jobs

    used = []

    def fit(texts, **settings):
        used.append(settings)
        raise InterruptedError

    monkeypatch.setattr(jobs.V, "texts", lambda *_: spark.createDataFrame([(1, "some words")], "doc_id long, text string"))
    monkeypatch.setattr(jobs.M, "fit_word_vectors", fit)
    with pytest.raises(InterruptedError):
        jobs.m10(spark, "none")
    assert used == [{}]
