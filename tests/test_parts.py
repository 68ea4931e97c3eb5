"""Tables in parts: touched folders only, runs again without harm, replies never without a question."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from threadloom.operators.ranking import best_per_key, one_per_key
from threadloom.sources import parts as P
from threadloom.sources.tables import POSTS
from threadloom.streaming.ingest import ingest_paired_posts, paired


def posts(spark, rows):
    """(comment_id, parent_id, score) as posts."""
    made = spark.createDataFrame(rows, "comment_id long, parent_id long, score long")
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in POSTS.fields if f.name not in made.columns]
    return made.select("*", *rest).select(*[f.name for f in POSTS.fields])


def ids(spark, table):
    return sorted(r["comment_id"] for r in P.load_parted(spark, table, POSTS).collect())


def test_append_reads_the_touched_ranges_only(spark, tmp_path):
    table = f"{tmp_path}/posts"
    P.create_parted(spark, table, POSTS)
    P.append_parted(posts(spark, [(i, None, 0) for i in range(0, 1000, 10)]), table, POSTS, width=100)
    more = posts(spark, [(5, None, 0), (5, None, 1), (10, None, 9), (905, None, 0), (None, 3, 1)])
    stored = P.load_parted(spark, table, POSTS)
    plan = P.not_stored(more, stored, "comment_id", P.id_range("comment_id", 100))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "ReadSchema: struct<comment_id:bigint>" in plan
    assert P.touched(more, P.id_range("comment_id", 100)) == [0, 9]
    for _ in range(2):
        P.append_parted(more, table, POSTS, width=100)
    assert ids(spark, table) == sorted([*range(0, 1000, 10), 5, 905])


def test_upsert_leaves_other_files_alone(spark, tmp_path):
    table = f"{tmp_path}/best"
    P.create_parted(spark, table, POSTS)
    P.upsert_parted(posts(spark, [(i, i % 200, i % 7) for i in range(1000)]), table, POSTS, buckets=16)
    before = set(glob.glob(f"{table}/part=*/*.parquet"))
    batch = posts(spark, [(5000, 3, 100), (5001, 3, 100), (5002, 777, 1), (5003, None, 1), (5004, 5, None)])
    hit = P.touched(batch.where("parent_id is not null"), P.bucket("parent_id", 16))
    for _ in range(2):
        P.upsert_parted(batch, table, POSTS, buckets=16)
    after = set(glob.glob(f"{table}/part=*/*.parquet"))
    kept = {f for f in before if int(os.path.basename(os.path.dirname(f)).split("=")[1]) not in hit}
    assert kept and kept == before & after
    found = {r["parent_id"]: (r["comment_id"], r["score"]) for r in P.load_parted(spark, table, POSTS).collect()}
    assert found[3] == (5000, 100) and found[777] == (5002, 1) and len(found) == 201
    want = {p: min(((-(i % 7), i) for i in range(1000) if i % 200 == p)) for p in range(200)}
    assert all(found[p] == (i, -s) for p, (s, i) in want.items() if p != 3)


def test_row_choices(spark):
    rows = spark.createDataFrame([(1, 5, 1, "a"), (1, 5, 1, "b"), (1, 7, 2, "c"), (None, 1, 3, "d"), (None, None, 4, "e"), (2, None, 5, "f")], "k int, s int, i int, t string")
    assert {tuple(r) for r in one_per_key(rows, ["k"], [F.asc("t")]).collect()} == {(1, 5, 1, "a"), (None, 1, 3, "d"), (2, None, 5, "f")}
    assert {tuple(r) for r in best_per_key(rows, ["k"], "s", "i").collect()} == {(1, 7, 2, "c"), (None, 1, 3, "d"), (2, None, 5, "f")}
    assert {tuple(r) for r in best_per_key(rows, ["k"], "s", "i", highest=False).collect()} == {(1, 5, 1, "a"), (None, 1, 3, "d"), (2, None, 5, "f")}


@pytest.fixture
def folders(tmp_path):
    return [f"{tmp_path}/{n}" for n in ("incoming", "posts", "waiting", "mark")]


def test_replies_wait_for_their_question(spark, folders):
    incoming, table, waiting, mark = folders
    waves = [[(11, 10, 1), (21, 20, 1), (31, 30, 1)], [(10, None, 1), (22, 20, 1)], [(20, None, 1), (12, 10, 1)], [(13, 10, 1)]]
    stored = [[], [10, 11], [10, 11, 12, 20, 21, 22], [10, 11, 12, 13, 20, 21, 22]]
    for wave, want in zip(waves, stored):
        posts(spark, wave).coalesce(1).write.mode("append").parquet(incoming)
        ingest_paired_posts(spark, incoming, table, waiting, mark, width=8)
        assert ids(spark, table) == want
    assert {r["comment_id"] for r in spark.read.parquet(waiting).collect()} == {11, 21, 22, 31}


def test_a_batch_run_again_does_no_harm_and_patience_ends(spark, folders):
    _, table, waiting, _ = folders
    incoming = f"{folders[0]}-none"
    posts(spark, []).write.parquet(incoming)
    ingest_paired_posts(spark, incoming, table, waiting, folders[3], width=8)
    batches = [posts(spark, [(11, 10, 1)]), posts(spark, [(21, 20, 1)]), posts(spark, [(1, None, 1)]), posts(spark, [(10, None, 1), (20, None, 1)])]
    for number, batch in enumerate(batches, 1):
        for _ in range(2):
            paired(batch, number, table, waiting, POSTS, 8, patience=2)
    assert ids(spark, table) == [1, 10, 20, 21]


def test_a_batch_writes_few_files_to_a_folder(spark, tmp_path):
    table, old = f"{tmp_path}/posts", spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    P.create_parted(spark, table, POSTS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as for a batch of many megabytes
    try:
        P.append_parted(posts(spark, [(i, None, 0) for i in range(4000)]), table, POSTS, width=250)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert ids(spark, table) == list(range(4000))
    assert len(glob.glob(f"{table}/part=*/*.parquet")) == 16
