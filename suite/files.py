"""Sources and sinks: driver tables written as dump files, read back, compared with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import views as V
from suite.registry import query
from threadloom.session import scratch_path
from threadloom.sources import delimited as D
from threadloom.sources import dumps as X
from threadloom.sources import tables as B
from threadloom.operators.selection import csv_answers_as_posts
from threadloom.sources.parts import create_parted, load_parted, upsert_parted
from threadloom.streaming.ingest import ingest_paired_posts, ingest_posts
from suite import sqltext as S

POST = "comment_id, parent_id, comment, title, CAST(date AS VARCHAR) AS date, score, tags"


def dump_xml(df, spark, **attributes):
    """One ``<row …/>`` line per record; a null attribute is left out."""

    def escaped(column):
        for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
            column = F.replace(column, F.lit(old), F.lit(new))
        return column

    parts = [
        F.coalesce(F.concat(F.lit(f' {name}="'), escaped(column.cast("string")), F.lit('"')), F.lit(""))
        for name, column in attributes.items()
    ]
    path = scratch_path(spark, "dump")
    df.select(F.concat(F.lit("<row"), *parts, F.lit(" />"))).write.text(path)
    return path


def posts_dump(spark, sf):
    p = V.posts(spark, sf)
    c = F.col
    return dump_xml(
        p, spark, Id=c("comment_id"), PostTypeId=F.when(c("parent_id").isNull(), 1).otherwise(2), ParentId=c("parent_id"),
        Score=c("score"), CreationDate=F.concat(c("date").cast("string"), F.lit("T08:15:30.123")), Body=c("comment"),
        Title=c("title"), Tags=c("tags"),
    )


@query("s01_posts_dump", """SELECT comment_id AS id, CASE WHEN parent_id IS NULL THEN 1 ELSE 2 END AS post_type_id, parent_id, score,
CAST(date AS VARCHAR) AS date, comment AS body, title, tags FROM posts""")
def s01(spark, sf):
    read = X.posts_dump(spark, posts_dump(spark, sf))
    return read.drop("accepted_answer_id").withColumn("date", F.col("date").cast("string"))


@query("s02_links_dump", "SELECT post_id, related_post_id, link_type_id FROM links")
def s02(spark, sf):
    df = V.links(spark, sf)
    path = dump_xml(df, spark, PostId=F.col("post_id"), RelatedPostId=F.col("related_post_id"), LinkTypeId=F.col("link_type_id"))
    return X.links_dump(spark, path)


@query("s03_tags_dump", "SELECT p_partkey % 500 AS id, max(p_name) AS tag_name FROM part GROUP BY 1")
def s03(spark, sf):
    df = V.table(spark, sf, "part")
    return X.tags_dump(spark, dump_xml(df, spark, Id=F.col("p_partkey") % 500, TagName=F.col("p_name")))


@query("s04_comments_dump", "SELECT conv_id * 100 + turn AS id, conv_id AS post_id, turn AS score, text FROM conversations")
def s04(spark, sf):
    df = V.table(spark, sf, "conversations")
    path = dump_xml(df, spark, Id=F.col("conv_id") * 100 + F.col("turn"), PostId=F.col("conv_id"), Score=F.col("turn"), Text=F.col("text"))
    return X.comments_dump(spark, path)


@query("s05_latin1_csv", """SELECT qid AS "Id", conv_id AS "OwnerUserId", '2020-01-01' AS "CreationDate", turn AS "Score", question AS "Title", reply AS "Body" FROM turn_pairs""")
def s05(spark, sf):
    df = V.turn_pairs(spark, sf).select(
        F.col("qid").alias("Id"), F.col("conv_id").alias("OwnerUserId"), F.lit("2020-01-01").alias("CreationDate"),
        F.col("turn").alias("Score"), F.col("question").alias("Title"), F.col("reply").alias("Body"))
    path = scratch_path(spark, "questions.csv")
    D.write_csv(df, path, encoding="ISO-8859-1")
    return D.csv_dump(spark, path, D.QUESTIONS)


@query("s07_word_vector_file", "SELECT word, pos - 1 AS pos, round(v, 6) + 0.0 AS x FROM (SELECT word, unnest(vec) AS v, generate_subscripts(vec, 1) AS pos FROM word_vectors)")
def s07(spark, sf):
    path = scratch_path(spark, "words.tsv")
    D.write_word_vectors(V.word_vectors(spark, sf), path)
    words = D.word_vector_file(spark, path)
    return words.select("word", F.posexplode("vec").alias("pos", "v")).select(
        "word", F.col("pos").cast("bigint").alias("pos"), F.round("v", 6).alias("x"))


ONE_LINE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def _corpus_file(spark, sf):
    one = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    path = scratch_path(spark, "corpus.tsv")
    V.turn_pairs(spark, sf).select(F.concat_ws("\t", one("question"), one("reply"))).write.text(path)
    return path


@query("s08_tsv_corpus", f"SELECT {ONE_LINE.format('question')} AS question, {ONE_LINE.format('reply')} AS first FROM turn_pairs")
def s08(spark, sf):
    cases = D.ranking_cases(D.tsv_corpus(spark, _corpus_file(spark, sf)))
    return cases.select("question", F.get("cands", F.lit(0)).alias("first"))


@query("s09_keyed_append", f"SELECT {POST} FROM posts")
def s09(spark, sf):
    posts = V.posts(spark, sf)
    path = scratch_path(spark, "posts")
    B.create_table(spark, path)
    B.append_new(posts.where("parent_id is null"), path)
    B.append_new(posts.unionAll(posts), path)
    return B.scan(spark, path).withColumn("date", F.col("date").cast("string"))


@query("s10_csv_sink", """SELECT "Id", "ParentId", "Score", "Body" FROM csv_answers""")
def s10(spark, sf):
    path = scratch_path(spark, "answers.csv")
    D.write_csv(V.csv_answers(spark, sf), path, header=False)
    return spark.read.csv(path, schema="Id bigint, ParentId bigint, Score bigint, Body string", quote='"', escape='"')


@query("s11_prepared_file", f"SELECT {S.search_text(ONE_LINE.format('question'), False)} || chr(9) || {S.search_text(ONE_LINE.format('reply'), False)} AS value FROM turn_pairs")
def s11(spark, sf):
    target = scratch_path(spark, "prepared.tsv")
    D.prepare_file(spark, _corpus_file(spark, sf), target)
    return spark.read.text(target)


@query("s12_vectors_by_tag", "SELECT tag::VARCHAR AS tag, comment_id, round(list_sum(vec), 6) + 0.0 AS total FROM labelled_vectors")
def s12(spark, sf):
    path = scratch_path(spark, "vectors")
    B.save_vectors(V.labelled_vectors(spark, sf), path)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    return B.load_vectors(spark, path).select("tag", "comment_id", F.round(total, 6).alias("total"))


#: Posts to a dump file: one task writes it and one batch takes it in.
FILE_POSTS = 200_000


def _in_files(posts, least=1):
    """Posts dealt over dump files of bounded size, ``least`` of them or more."""
    return posts.repartition(max(least, posts.count() // FILE_POSTS + 1), "comment_id")


@query("s13_incremental_ingest", f"SELECT {POST} FROM posts")
def s13(spark, sf):
    incoming, table, mark = (scratch_path(spark, n) for n in ("incoming", "posts", "checkpoint"))
    posts = V.posts(spark, sf)
    _in_files(posts, 3).write.parquet(incoming)
    ingest_posts(spark, incoming, table, mark)
    _in_files(posts.where("parent_id is not null")).write.mode("append").parquet(incoming)
    ingest_posts(spark, incoming, table, mark)
    return B.scan(spark, table).withColumn("date", F.col("date").cast("string"))


PAIRED = """FROM posts p WHERE parent_id IS NULL AND comment_id % 12 <> 0 OR parent_id % 12 <> 0"""


def _without_some_questions(spark, sf):
    """Posts whose every third question is missing, so its replies are orphans."""
    return V.posts(spark, sf).where("parent_id is not null or comment_id % 12 <> 0")


@query("s13_paired_ingest", f"SELECT {POST} {PAIRED}")
def s13_paired(spark, sf):
    """Replies come before, with and after their questions; those whose question never comes stay out."""
    incoming, table, waiting, mark = (scratch_path(spark, n) for n in ("incoming", "posts", "waiting", "checkpoint"))
    posts = _without_some_questions(spark, sf)
    waves = ["parent_id is not null and comment_id % 4 = 1", "parent_id is null and comment_id % 8 = 0 or comment_id % 4 = 2", "comment_id % 4 <> 1"]
    for wave in waves:
        _in_files(posts.where(wave), 3).write.mode("append").parquet(incoming)
        ingest_paired_posts(spark, incoming, table, waiting, mark, width=1 << 8)
    return load_parted(spark, table, B.POSTS).drop("part").withColumn("date", F.col("date").cast("string"))


@query("u05_waiting_orphans", """SELECT p.comment_id, p.parent_id FROM posts p WHERE parent_id % 12 = 0""")
def u05_waiting(spark, sf):
    """The replies that a clean-up drops: they wait for a question that never came."""
    incoming, table, waiting, mark = (scratch_path(spark, n) for n in ("incoming", "posts", "waiting", "checkpoint"))
    _without_some_questions(spark, sf).repartition(3, "comment_id").write.parquet(incoming)
    ingest_paired_posts(spark, incoming, table, waiting, mark, files_per_batch=2)
    posts = load_parted(spark, table, B.POSTS)
    return spark.read.parquet(waiting).select("comment_id", "parent_id").join(posts.select("comment_id"), "comment_id", "left_anti")


BATCHES = """WITH both_sides AS (SELECT parent_id, comment_id, score FROM posts WHERE parent_id IS NOT NULL UNION ALL
SELECT l_orderkey, 100000000 + l_orderkey * 10 + l_linenumber, l_suppkey % 7 - 1 FROM lineitem)
SELECT parent_id, comment_id, score FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY score DESC, comment_id) AS r FROM both_sides) WHERE r = 1"""


@query("u04_stored_upsert", BATCHES)
def u04_stored(spark, sf):
    """Three batches into a table of hashed buckets, the last one again."""
    path = scratch_path(spark, "best")
    stored = V.posts(spark, sf).where("parent_id is not null").select("parent_id", "comment_id", "score")
    incoming = csv_answers_as_posts(V.csv_answers(spark, sf)).select("parent_id", "comment_id", "score")
    create_parted(spark, path, stored.schema)
    for batch in (stored, incoming.where("comment_id % 2 = 0"), incoming.where("comment_id % 2 = 1"), incoming.where("comment_id % 2 = 1")):
        upsert_parted(batch, path, stored.schema)
    return load_parted(spark, path, stored.schema).drop("part")
