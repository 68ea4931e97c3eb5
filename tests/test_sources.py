"""Tiny files written here and read through the sources; keyed appends; incremental ingest."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from threadloom.plans.corpus import build_posts
from threadloom.session import shared_dir, written
from threadloom.sources import delimited as D
from threadloom.sources import dumps as X
from threadloom.sources import tables as B
from threadloom.streaming.ingest import ingest_posts

POSTS = """<?xml version="1.0" encoding="utf-8"?>
<posts>
  <row Id="1" PostTypeId="1" Score="5" CreationDate="2012-03-04T05:06:07.890" Body="How?&#xA;&lt;code&gt;x&lt;/code&gt; &quot;q&quot;" Title="A  title &amp;amp; more" Tags="&lt;c#&gt;&lt;.net&gt;" AcceptedAnswerId="2" />
  <row Id="2" PostTypeId="2" ParentId="1" Score="3" CreationDate="2012-03-05T00:00:00.000" Body="  So  " />
  <row Id="3" PostTypeId="2" ParentId="1" Score="0" CreationDate="2012-03-06T00:00:00.000" Body="no" />
  <row Id="4" PostTypeId="1" Score="oops" CreationDate="2012-03-07T00:00:00.000" Body="bad score" />
  <row Id="5" PostTypeId="1" Score="9" CreationDate="2012-03-08T00:00:00.000" Body="no tags" Title="t" />
  <row Id="5" PostTypeId="1" Score="9" CreationDate="2012-03-08T00:00:00.000" Body="no tags" Title="t" />
</posts>
"""


@pytest.fixture
def posts_file(tmp_path):
    path = tmp_path / "Posts.xml"
    path.write_text(POSTS, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("lines", [True, False])
def test_posts_dump(spark, posts_file, lines):
    rows = {r["id"]: r for r in X.posts_dump(spark, posts_file, one_per_line=lines).collect()}
    assert sorted(rows) == [1, 2, 3, 5]
    assert rows[1]["body"] == 'How?\n<code>x</code> "q"'
    assert rows[1]["date"] == dt.date(2012, 3, 4)
    assert (rows[1]["accepted_answer_id"], rows[1]["parent_id"], rows[2]["parent_id"]) == (2, None, 1)
    assert rows[5]["tags"] is None


def test_build_posts(spark, posts_file):
    rows = {r["comment_id"]: r for r in build_posts(X.posts_dump(spark, posts_file)).collect()}
    assert sorted(rows) == [1, 2, 5]
    assert rows[1]["comment"] == "How?\n<code>x</code> 'q'"
    assert rows[1]["title"] == "A title && more"
    assert rows[1]["tags"] == "c# .net"
    assert (rows[2]["comment"], rows[2]["title"], rows[2]["tags"]) == ("So", None, None)


def test_links_tags_comments(spark, tmp_path):
    (tmp_path / "l.xml").write_text('<l>\n<row PostId="5" RelatedPostId="1" LinkTypeId="3" />\n<row PostId="" RelatedPostId="2" LinkTypeId="1" />\n</l>')
    assert [tuple(r) for r in X.links_dump(spark, str(tmp_path / "l.xml")).collect()] == [(5, 1, 3), (None, 2, 1)]
    (tmp_path / "t.xml").write_text('<t>\n<row Id="1" TagName="a" />\n<row Id="1" TagName="b" />\n<row Id="2" TagName="c" />\n</t>')
    assert {tuple(r) for r in X.tags_dump(spark, str(tmp_path / "t.xml")).collect()} == {(1, "b"), (2, "c")}
    (tmp_path / "c.xml").write_text('<c>\n<row Id="1" PostId="7" Score="2" Text="a &gt; b" />\n</c>')
    assert [tuple(r) for r in X.comments_dump(spark, str(tmp_path / "c.xml")).collect()] == [(1, 7, 2, "a > b")]


def test_latin1_csv(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_bytes('Id,OwnerUserId,CreationDate,Score,Title,Body\n1,2,2010-01-01,3,"caf\xe9 ""x""","line one\nline two"\n'.encode("latin1"))
    row = D.csv_dump(spark, str(path), D.QUESTIONS).first()
    assert (row["Title"], row["Body"], row["Score"]) == ('café "x"', "line one\nline two", 3)


def test_word_vector_file(spark, tmp_path):
    path = tmp_path / "w.tsv"
    path.write_text("code\t1\t2.5\nword\t-1\t0.25\n")
    words = D.word_vector_file(spark, str(path))
    assert {r["word"]: r["vec"] for r in words.collect()} == {"code": [1.0, 2.5], "word": [-1.0, 0.25]}
    assert D.vector_dim(words) == 2
    path.write_text("code\t1\t2.5\nword\t-1\n")
    with pytest.raises(ValueError):
        D.vector_dim(D.word_vector_file(spark, str(path)))


def test_tsv_corpus_and_preparation(spark, tmp_path):
    path = tmp_path / "c.tsv"
    path.write_text("How do I sort?\tSorting a LIST\tother [x] \n")
    cases = D.ranking_cases(D.tsv_corpus(spark, str(path))).first()
    assert (cases["question"], cases["cands"]) == ("How do I sort?", ["Sorting a LIST", "other [x]"])
    D.prepare_file(spark, str(path), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "sort\tsorting list\tx"


def test_keyed_append_drops_known_and_repeated_keys(spark, tmp_path):
    path = str(tmp_path / "posts")
    B.create_table(spark, path)
    row = "bigint, parent_id bigint, comment string, title string, date date, score bigint, tags string"
    first = spark.createDataFrame([(1, None, "a", "t", None, 1, None), (1, None, "b", "t", None, 1, None)], "comment_id " + row)
    B.append_new(first, path)
    B.append_new(first.unionAll(spark.createDataFrame([(2, 1, "c", None, None, 1, None)], "comment_id " + row)), path)
    assert sorted((r["comment_id"], r["comment"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_incremental_ingest_equals_batch(spark, tmp_path, posts_file):
    incoming, table, mark = (str(tmp_path / n) for n in ("in", "posts", "mark"))
    posts = build_posts(X.posts_dump(spark, posts_file))
    posts.where("comment_id < 5").repartition(2).write.parquet(incoming)
    ingest_posts(spark, incoming, table, mark)
    posts.coalesce(1).write.mode("append").parquet(incoming)
    ingest_posts(spark, incoming, table, mark)
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == sorted(map(tuple, posts.collect()))


def test_vectors_by_tag_read_only_asked_folders(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = [("a", i, [float(i)]) for i in range(20)] + [("b", 99, [1.0])]
    B.save_vectors(spark.createDataFrame(rows, "tag string, comment_id bigint, vec array<double>"), path)
    stored = B.load_vectors(spark, path)
    assert stored.count() == 21
    assert [r["comment_id"] for r in stored.where(F.col("tag") == "b").collect()] == [99]


def test_written_tables_live_in_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        assert shared_dir(spark) == named.rstrip("/")
    table = written(spark.range(5), "r")
    assert table.count() == 5
    assert all(shared_dir(spark) in name for name in table.inputFiles())


def test_dump_files_hold_a_bounded_number_of_posts(spark, monkeypatch):
    from suite import files

    monkeypatch.setattr(files, "FILE_POSTS", 100)
    posts = spark.range(950).select(F.col("id").alias("comment_id"))
    assert files._in_files(posts).rdd.getNumPartitions() == 10
    assert files._in_files(posts.where("comment_id < 50"), 3).rdd.getNumPartitions() == 3
