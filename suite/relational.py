"""Filters, joins, aggregates and table upkeep on the stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import sqltext as S
from suite import views as V
from suite.registry import query
from threadloom.operators import aggregates as A
from threadloom.operators import joins as J
from threadloom.operators import maintenance as U
from threadloom.operators import ranking as R
from threadloom.operators import selection as P
from threadloom.functions.text import storage_tags
from threadloom.sources.tables import scan

POST = "comment_id, parent_id, comment, title, CAST(date AS VARCHAR) AS date, score, tags"


def dated(df):
    return df.withColumn("date", F.col("date").cast("string")) if "date" in df.columns else df


# --- filters and projections ----------------------------------------------------------------------

@query("s06_projected_scan", "SELECT comment_id, title, tags FROM posts WHERE parent_id IS NULL")
def s06(spark, sf):
    return P.questions_only(V.posts(spark, sf)).select("comment_id", "title", "tags")


@query("f01_positive_score", f"SELECT {POST} FROM posts WHERE score > 0")
def f01(spark, sf):
    return dated(P.positive_score(V.posts(spark, sf)))


@query("f02_question_answer_split", """SELECT 'q' AS kind, count(*) AS n, sum(length(title))::BIGINT AS chars FROM posts WHERE parent_id IS NULL
UNION ALL SELECT 'a', count(*), sum(length(comment))::BIGINT FROM posts WHERE parent_id IS NOT NULL""")
def f02(spark, sf):
    posts = V.posts(spark, sf)
    q = P.questions_only(posts).agg(F.lit("q").alias("kind"), F.count("*").alias("n"), F.sum(F.length("title")).alias("chars"))
    a = P.answers_only(posts).agg(F.lit("a").alias("kind"), F.count("*").alias("n"), F.sum(F.length("comment")).alias("chars"))
    return q.unionByName(a)


@query("f03_acceptable_long", "SELECT comment_id FROM posts WHERE len(string_split(comment, ' ')) <= 250 AND length(comment) BETWEEN 1 AND 10000")
def f03(spark, sf):
    return V.posts(spark, sf).where(P.acceptable_long(F.col("comment"))).select("comment_id")


@query("f04_acceptable_short", f"""SELECT comment_id FROM posts WHERE NOT contains(comment, '<code>')
AND len({S.space_tokens("comment")}) <= 150 AND length(comment) BETWEEN 1 AND 1000""")
def f04(spark, sf):
    return V.posts(spark, sf).where(P.acceptable_short(F.col("comment"))).select("comment_id")


@query("f05_without_literal", "SELECT comment_id FROM posts WHERE NOT contains(comment, 'token')")
def f05(spark, sf):
    return P.without_literal(V.posts(spark, sf), "comment", "token").select("comment_id")


@query("f06_usable_pairs", "SELECT qid, question AS title, reply AS comment FROM turn_pairs WHERE length(reply) > 100 AND length(question) > 20")
def f06(spark, sf):
    pairs = V.turn_pairs(spark, sf).select("qid", F.col("question").alias("title"), F.col("reply").alias("comment"))
    return P.usable_pairs(pairs)


@query("f07_high_scores", "SELECT comment_id, score, title FROM posts WHERE parent_id IS NULL AND score > 3 ORDER BY comment_id LIMIT 10")
def f07(spark, sf):
    return P.high_scoring_questions(V.posts(spark, sf), above=3).select("comment_id", "score", "title")


@query("f08_point_lookup", "SELECT title, score FROM posts WHERE comment_id = 8")
def f08(spark, sf):
    return P.lookup(V.posts(spark, sf), 8, "title", "score")


@query("f09_existing_ends", "SELECT post_id, related_post_id, link_type_id FROM links WHERE related_post_id IN (SELECT comment_id FROM posts)")
def f09(spark, sf):
    return P.existing(V.links(spark, sf), V.posts(spark, sf), "related_post_id").select("post_id", "related_post_id", "link_type_id")


@query("f10_posts_with_ids", f"SELECT {POST} FROM posts WHERE comment_id IN (SELECT related_post_id FROM links)")
def f10(spark, sf):
    return dated(P.posts_with_ids(V.posts(spark, sf), V.links(spark, sf), "related_post_id"))


@query("f11_tagged_with_any", f"""SELECT comment_id, {S.storage_tags("tags")} AS tags FROM posts
WHERE list_has_any({S.space_tokens(S.storage_tags("tags"))}, ['fr', 'src3', 'src5'])""")
def f11(spark, sf):
    cleaned = V.posts(spark, sf).withColumn("tags", storage_tags(F.col("tags"), "common"))
    return P.tagged_with_any(cleaned, ["fr", "src3", "src5"]).select("comment_id", "tags")


@query("f12_csv_as_posts", """SELECT "Id" AS comment_id, NULL::BIGINT AS parent_id, "Body" AS comment, "Title" AS title, "Score" AS score, 'none' AS tags FROM csv_questions""")
def f12(spark, sf):
    return P.csv_questions_as_posts(V.csv_questions(spark, sf).withColumn("Tag", F.lit("none")))


@query("f13_distinct_parents", """SELECT count(DISTINCT a.parent_id) AS parents FROM posts a JOIN posts q ON a.parent_id = q.comment_id
WHERE a.comment IS NOT NULL AND q.comment IS NOT NULL""")
def f13(spark, sf):
    return P.distinct_parents(J.with_parent_fields(V.posts(spark, sf)))


@query("f14_askable", "SELECT qid, question FROM questions WHERE length(trim(question)) >= 1")
def f14(spark, sf):
    return P.askable(V.questions(spark, sf)).select("qid", "question")


# --- joins ----------------------------------------------------------------------------------------

@query("j01_questions_with_tags", """SELECT q."Id", q."Title", t.tags FROM csv_questions q LEFT JOIN
(SELECT "Id", string_agg("Tag", ' ' ORDER BY "Tag") AS tags FROM csv_tags GROUP BY "Id") t ON q."Id" = t."Id" """)
def j01(spark, sf):
    tags = A.joined_tags(V.csv_tags(spark, sf))
    return J.with_tags(V.csv_questions(spark, sf), tags).select("Id", "Title", F.col("Tag").alias("tags"))


@query("j04_answer_ids", """SELECT DISTINCT w.comment_id AS parent_id, p.comment_id AS answer_id
FROM (SELECT related_post_id AS comment_id FROM links) w JOIN posts p ON p.parent_id = w.comment_id""")
def j04(spark, sf):
    found = V.links(spark, sf).select(F.col("related_post_id").alias("comment_id"))
    return J.answer_ids_of(found, V.posts(spark, sf))


@query("j05_parent_fields", """SELECT a.comment_id, a.parent_id, q.comment AS parent, a.comment, q.title, CAST(a.date AS VARCHAR) AS unix, a.score, q.tags
FROM posts a LEFT JOIN posts q ON a.parent_id = q.comment_id WHERE a.parent_id IS NOT NULL""")
def j05(spark, sf):
    return J.with_parent_fields(V.posts(spark, sf)).withColumn("unix", F.col("unix").cast("string"))


@query("j05_parent_reply", """SELECT a.comment_id, a.parent_id, q.comment AS parent, a.comment,
CASE WHEN a.parent_id IS NULL THEN a.title ELSE q.title END AS title, CAST(a.date AS VARCHAR) AS unix, a.score,
CASE WHEN a.parent_id IS NULL THEN a.tags ELSE q.tags END AS tags FROM posts a LEFT JOIN posts q ON a.parent_id = q.comment_id""")
def j05r(spark, sf):
    return J.parent_reply(V.posts(spark, sf)).withColumn("unix", F.col("unix").cast("string"))


@query("j06_parent_text", """SELECT a.comment_id, a.parent_id, q.comment AS title FROM dialogue_posts a LEFT JOIN dialogue_posts q ON a.parent_id = q.comment_id
WHERE a.parent_id IS NOT NULL""")
def j06(spark, sf):
    posts = V.dialogue_posts(spark, sf)
    return J.with_parent_text(posts.where("parent_id is not null"), posts).select("comment_id", "parent_id", "title")


@query("j07_duplicate_pairs", "SELECT post_id, related_post_id FROM dup_pairs")
def j07(spark, sf):
    return J.duplicate_pairs(V.links(spark, sf), V.link_posts(spark, sf)).select("post_id", "related_post_id")


@query("j08_missing_questions", """SELECT "Id", "Title" FROM csv_questions WHERE "Id" NOT IN (SELECT comment_id FROM posts)""")
def j08(spark, sf):
    return J.missing_questions(V.csv_questions(spark, sf), V.posts(spark, sf)).select("Id", "Title")


@query("j09_answers_of_missing", """SELECT "Id", "ParentId", "Score", "Body" FROM csv_answers WHERE "ParentId" IN
(SELECT "Id" FROM csv_questions WHERE "Id" NOT IN (SELECT comment_id FROM posts))""")
def j09(spark, sf):
    missing = J.missing_questions(V.csv_questions(spark, sf), V.posts(spark, sf))
    return J.answers_of(V.csv_answers(spark, sf), missing).select("Id", "ParentId", "Score", "Body")


@query("j10_answers_to_kept", """SELECT comment_id, parent_id FROM posts WHERE parent_id IN
(SELECT comment_id FROM posts WHERE parent_id IS NULL AND score > 0)""")
def j10(spark, sf):
    posts = V.posts(spark, sf)
    kept = P.positive_score(posts.where("parent_id is null"))
    return J.answers_to_kept(posts, kept).select("comment_id", "parent_id")


@query("j11_tokens_with_vectors", """SELECT d.doc_id, d.word, round(w.vec[1], 6) AS first FROM
(SELECT doc_id, unnest(tokens) AS word FROM doc_tokens) d JOIN word_vectors w ON d.word = w.word""")
def j11(spark, sf):
    from threadloom.functions.text import search_tokens

    tokens = V.table(spark, sf, "documents").select("doc_id", F.explode(search_tokens(F.col("text"))).alias("word"))
    found = J.tokens_with_vectors(tokens, V.word_vectors(spark, sf))
    return found.select("doc_id", "word", F.round(F.get("vec", F.lit(0)), 6).alias("first"))


@query("j12_tokens_with_idf", """SELECT q.qid, q.word, round(coalesce(i.idf, 0), 6) AS idf FROM
(SELECT qid, unnest(list_filter(string_split(text, ' '), lambda w: w <> '')) AS word FROM question_texts) q LEFT JOIN idf i ON q.word = i.term""")
def j12(spark, sf):
    from threadloom.functions.text import search_tokens

    tokens = V.questions(spark, sf).select("qid", F.explode(search_tokens(F.col("question"))).alias("word"))
    return J.tokens_with_idf(tokens, V.idf(spark, sf)).select("qid", "word", F.round("idf", 6).alias("idf"))


# --- aggregates -----------------------------------------------------------------------------------

@query("a01_joined_tags", """SELECT "Id", string_agg("Tag", ' ' ORDER BY "Tag") AS tags FROM csv_tags GROUP BY "Id" """)
def a01(spark, sf):
    return A.joined_tags(V.csv_tags(spark, sf)).select("Id", F.col("Tag").alias("tags"))


@query("a02_parent_answer_lists", """SELECT parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY comment_id) AS position, comment_id AS answer_id
FROM posts WHERE parent_id IS NOT NULL""")
def a02(spark, sf):
    return A.parent_answer_lists(V.posts(spark, sf))


FOUND_SQL = """found AS (SELECT q.comment_id, q.comment AS comment_parent, q.title, q.score AS score_parent, q.tags,
round(q.score / 7.0, 6) AS distances, a.parent_id, a.comment_id AS answer_id, a.comment AS comment_comment, a.score AS score_comment
FROM posts q JOIN posts a ON a.parent_id = q.comment_id WHERE q.parent_id IS NULL)"""


def _found(spark, sf):
    posts = V.posts(spark, sf)
    parents = posts.where("parent_id is null").withColumn("distances", F.round(F.col("score") / 7.0, 6))
    return J.parents_with_answers(parents, posts.where("parent_id is not null"))


@query("j03_parents_with_answers", f"WITH {FOUND_SQL} SELECT comment_id, answer_id, distances, score_parent, score_comment, comment_comment FROM found")
def j03(spark, sf):
    return _found(spark, sf).select("comment_id", "answer_id", "distances", "score_parent", "score_comment", "comment_comment")


@query("j02_with_distances", """SELECT p.comment_id, p.score, round(min(w.d), 6) AS distances FROM posts p LEFT JOIN
(SELECT related_post_id AS id, post_id / 7.0 AS d FROM links) w ON p.comment_id = w.id GROUP BY 1, 2""")
def j02(spark, sf):
    near = V.links(spark, sf).select(F.col("related_post_id").alias("comment_id"), (F.col("post_id") / 7.0).alias("distances"))
    joined = J.with_distances(V.posts(spark, sf), near)
    return joined.select("comment_id", "score", F.round("distances", 6).alias("distances"))


@query("a03_combined_answers", f"""WITH {FOUND_SQL}
SELECT comment_id, distances, string_agg(comment_comment || '::' || score_comment::VARCHAR, chr(10) || '--' ORDER BY score_comment DESC, answer_id) AS combined
FROM found WHERE title IS NOT NULL AND tags IS NOT NULL GROUP BY 1, 2""")
def a03(spark, sf):
    posts = V.posts(spark, sf)
    parents = posts.where("parent_id is null").withColumn("distances", F.round(F.col("score") / 7.0, 6))
    lists = A.combined_answers(parents, posts.where("parent_id is not null"))
    return lists.select("comment_id", "distances", F.array_join("combined_comments", "\n--").alias("combined"))


@query("a04_duplicate_lists", """SELECT related_post_id, row_number() OVER (PARTITION BY related_post_id ORDER BY post_id) AS position, post_id
FROM dup_pairs""")
def a04(spark, sf):
    return A.duplicate_lists(J.duplicate_pairs(V.links(spark, sf), V.link_posts(spark, sf)))


@query("a05_best_answer", f"""WITH {FOUND_SQL} SELECT comment_id, answer_id, score_comment FROM
(SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY score_comment DESC, answer_id) AS rank FROM found) WHERE rank = 1""")
def a05(spark, sf):
    return A.best_answer(_found(spark, sf)).select("comment_id", "answer_id", "score_comment")


@query("a06_column_maxima", """SELECT parent_id, max(comment) AS comment, max(score) AS score FROM dialogue_posts WHERE parent_id IS NOT NULL GROUP BY parent_id""")
def a06(spark, sf):
    return A.column_maxima(V.dialogue_posts(spark, sf).where("parent_id is not null").select("parent_id", "comment", "score"))


@query("a07_tag_counts", """SELECT "Tag" AS tag, count(*) AS count FROM csv_tags GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25""")
def a07(spark, sf):
    return A.value_counts(V.csv_tags(spark, sf).withColumnRenamed("Tag", "tag"), "tag", 25)


@query("a09_mean_vector", """SELECT pos, round(avg(v), 6) + 0.0 AS mean FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY pos""")
def a09(spark, sf):
    mean = A.mean_vector(V.labelled_vectors(spark, sf), "vec", V.DIM)
    return mean.select(F.posexplode("mean").alias("pos", "m")).select(F.col("pos").cast("bigint").alias("pos"), F.round("m", 6).alias("mean"))


@query("a11_length_histogram", """WITH l AS (SELECT len(string_split(comment, chr(10))) AS n FROM posts), b AS (SELECT min(n)::DOUBLE AS lo, (max(n) - min(n)) / 20.0 AS w FROM l)
SELECT g.bin, coalesce(c.n, 0) AS rows FROM (SELECT unnest(range(20)) AS bin) g LEFT JOIN
(SELECT least(floor((n - lo) / w), 19)::BIGINT AS bin, count(*) AS n FROM l, b GROUP BY 1) c ON g.bin = c.bin""")
def a11(spark, sf):
    sizes = V.posts(spark, sf).select(F.size(F.split("comment", "\n")).alias("n"))
    return A.length_histogram(sizes, "n")


@query("a12_row_count", "SELECT count(*) AS rows FROM posts")
def a12(spark, sf):
    return A.row_count(V.posts(spark, sf))


@query("a18_min_max_scaled", """SELECT comment_id, tag, CASE WHEN hi = lo THEN 0 ELSE round((x - lo) / (hi - lo), 6) END + 0.0 AS scaled FROM
(SELECT vec_id AS comment_id, label AS tag, embedding[1]::DOUBLE AS x, min(embedding[1]::DOUBLE) OVER (PARTITION BY label) AS lo, max(embedding[1]::DOUBLE) OVER (PARTITION BY label) AS hi FROM embeddings)""")
def a18(spark, sf):
    rows = V.labelled_vectors(spark, sf).select("comment_id", "tag", F.get("vec", F.lit(0)).alias("scaled"))
    return A.min_max_scaled(rows, ["scaled"], "tag").withColumn("scaled", F.round("scaled", 6))


# --- upkeep ---------------------------------------------------------------------------------------

@query("u01_all_posts", f"SELECT {POST} FROM posts")
def u01(spark, sf):
    posts = V.posts(spark, sf)
    asked, given = posts.where("parent_id is null").drop("parent_id"), P.answers_only(posts)
    return dated(U.all_posts(asked, given).select(*posts.columns))


@query("u02_ids_not_stored", """SELECT DISTINCT "Id" AS comment_id FROM csv_questions WHERE "Id" NOT IN (SELECT comment_id FROM posts)""")
def u02(spark, sf):
    incoming = V.csv_questions(spark, sf).select(F.col("Id").alias("comment_id"))
    return U.ids_not_stored(incoming, V.posts(spark, sf))


@query("u03_appended", """SELECT comment_id, title, score FROM posts UNION ALL
SELECT "Id", "Title", "Score" FROM csv_questions WHERE "Id" NOT IN (SELECT comment_id FROM posts)""")
def u03(spark, sf):
    incoming = P.csv_questions_as_posts(V.csv_questions(spark, sf).withColumn("Tag", F.lit(None).cast("string")))
    stored = V.posts(spark, sf)
    return U.appended(stored.select("comment_id", "title", "score"), incoming.select("comment_id", "title", "score"))


UPSERT = """WITH both_sides AS (SELECT parent_id, comment_id, score FROM posts WHERE parent_id IS NOT NULL UNION ALL
SELECT l_orderkey, 100000000 + l_orderkey * 10 + l_linenumber, l_suppkey % 7 - 1 FROM lineitem)
SELECT parent_id, comment_id, score FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY score {0}, comment_id) AS r FROM both_sides) WHERE r = 1"""


def _upsert(spark, sf, keep):
    stored = V.posts(spark, sf).where("parent_id is not null").select("parent_id", "comment_id", "score")
    incoming = P.csv_answers_as_posts(V.csv_answers(spark, sf)).select("parent_id", "comment_id", "score")
    return U.upserted(stored, incoming, keep=keep)


@query("u04_upsert_highest", UPSERT.format("DESC"))
def u04h(spark, sf):
    return _upsert(spark, sf, "highest")


@query("u04_upsert_lowest", UPSERT.format("ASC"))
def u04l(spark, sf):
    return _upsert(spark, sf, "lowest")


@query("u05_without_orphans", """SELECT a.comment_id, a.parent_id FROM posts a JOIN posts q ON a.parent_id = q.comment_id WHERE q.score > 0""")
def u05(spark, sf):
    posts = V.posts(spark, sf)
    kept = posts.where("parent_id is not null or score > 0")
    return U.without_orphans(J.with_parent_fields(kept)).select("comment_id", "parent_id")


@query("u06_column", "SELECT comment_id FROM posts")
def u06(spark, sf):
    return U.column_of(V.posts(spark, sf), "comment_id")


# --- ranking --------------------------------------------------------------------------------------

@query("w07_answers_in_order", """SELECT parent_id, comment_id, score, row_number() OVER (PARTITION BY parent_id ORDER BY score DESC, comment_id) AS rank FROM posts WHERE parent_id IS NOT NULL""")
def w07(spark, sf):
    answers = V.posts(spark, sf).where("parent_id is not null").select("parent_id", "comment_id", "score")
    return R.full_rank(answers, ["parent_id"], [F.desc("score"), F.asc("comment_id")])
