"""Composite jobs and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import sqltext as S
from suite import views as V
from suite.files import posts_dump
from suite.registry import query
from threadloom.functions import constants as C
from threadloom.functions.text import search_tokens, storage_tags
from threadloom.operators import models as M
from threadloom.operators.neighbours import nearest
from threadloom.operators.selection import csv_questions_as_posts
from threadloom.plans import answers as Q
from threadloom.plans import corpus as P
from threadloom.session import scratch_path
from threadloom.sources.dumps import posts_dump as read_posts_dump
from threadloom.sources.models import TagModel, load_tag_model, save_tag_model

# --- splits and labels ----------------------------------------------------------------------------


@query("m02_encoded_labels", "SELECT doc_id, dense_rank() OVER (ORDER BY source) - 1 AS label FROM documents")
def m02(spark, sf):
    encoded, _ = M.encoded_labels(V.table(spark, sf, "documents").select("doc_id", "source"), "source")
    return encoded.select("doc_id", F.col("label").cast("bigint").alias("label"))


SHUFFLED = "md5('100:' || {0}::VARCHAR)"


@query("m03_stratified_split", f"""SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {SHUFFLED.format('doc_id')}, doc_id) <= ceil(count(*) OVER (PARTITION BY lang) * 0.1) AS is_test FROM documents""")
def m03(spark, sf):
    return M.stratified_split(V.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang")


RANDOM = f"('0x' || substr({SHUFFLED}, 1, 8))::BIGINT / 4294967296.0 < 0.1"


@query("m04_random_split", f"SELECT doc_id, {RANDOM.format('doc_id')} AS is_test FROM documents")
def m04(spark, sf):
    return M.random_split(V.table(spark, sf, "documents").select("doc_id"), "doc_id")


# --- models ---------------------------------------------------------------------------------------

def _labelled(spark, sf, vocab=None):
    """Documents with features, class number and split, written once since training passes over them.

    So are their words, which the vocabulary, the weights and the features read.
    """
    docs = V.texts(spark, sf).select("doc_id", "lang", search_tokens(F.col("text")).alias("tokens"))
    encoded, names = M.encoded_labels(M.random_split(V.written(docs, "tokens"), "doc_id"), "lang")
    features = M.fit_features(encoded.where("not is_test"), vocab=vocab)
    ready = V.written(features.transform(encoded).select("doc_id", "label", "is_test", "features"), "features")
    return ready, names, features


def _train(ready):
    return ready.where("not is_test").select("features", F.col("label").cast("double").alias("label"))


def _judged(scored):
    """Rows per split, and whether more are right than the commonest class would make."""
    hits = F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("right")
    most = F.max("n") / F.sum("n")
    common = scored.groupBy("is_test", "label").agg(F.count("*").alias("n")).groupBy("is_test").agg(most.alias("common"))
    found = scored.groupBy("is_test").agg(F.count("*").alias("rows"), hits).join(common, "is_test")
    return found.select("is_test", "rows", (F.col("right") > F.col("common")).alias("beats"))


JUDGED = f"SELECT {RANDOM.format('doc_id')} AS is_test, count(*) AS rows, TRUE AS beats FROM documents GROUP BY 1"


@query("m05_tag_classifier", JUDGED)
def m05(spark, sf):
    ready, _, _ = _labelled(spark, sf)
    train = _train(ready)
    model = M.fit_tag_classifier(train, train.count())
    return _judged(model.transform(ready.withColumn("label", F.col("label").cast("double"))))


def _tag_model(spark, sf):
    ready, names, features = _labelled(spark, sf)
    train = _train(ready)
    return TagModel(features, M.fit_tag_classifier(train, train.count()), tuple(names))


@query("m06_predicted_tags", "SELECT doc_id, TRUE AS few, TRUE AS falling FROM documents")
def m06(spark, sf):
    """One to three tags per document, with scores that fall and stay within 1."""
    docs = V.texts(spark, sf).select("doc_id", "text")
    scores = F.col("predicted")["score"]
    ordered = F.array_sort(scores, lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)) == scores
    inside = F.forall(scores, lambda s: (s >= 0) & (s <= 1 + 1e-9))
    found = _tag_model(spark, sf).predict(docs, "text")
    return found.select("doc_id", F.size(scores).between(1, 3).alias("few"), (ordered & inside).alias("falling"))


@query("s12_saved_classifier", "SELECT count(*) AS rows, TRUE AS same FROM documents")
def s12_saved(spark, sf):
    model, path = _tag_model(spark, sf), scratch_path(spark, "model")
    save_tag_model(model, spark, path)
    docs = V.texts(spark, sf).select("doc_id", "text")
    again = load_tag_model(spark, path).predict(docs, "text").select("doc_id", F.col("predicted").alias("again"))
    both = model.predict(docs, "text").join(again, "doc_id")
    return both.agg(F.count("*").alias("rows"), F.every(F.col("predicted") == F.col("again")).alias("same"))


_MODELS: dict[tuple[str, str], str] = {}


def _stored_model(spark, sf):
    """Folder of the tag model of a session, trained once as a service would."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        _MODELS[key] = scratch_path(spark, "tag_model")
        save_tag_model(_tag_model(spark, sf), spark, _MODELS[key])
    return _MODELS[key]


@query("p05_raw_questions", """SELECT item_id AS qid, TRUE AS ranked, TRUE AS within, TRUE AS whole FROM benchmark
WHERE length(trim(text)) >= 1""")
def p05_raw(spark, sf):
    """Raw texts answered by a stored classifier and a stored index.

    Checked per question: ranks run from 1 while weights fall, every answer is of a predicted tag, and each
    predicted tag gives the ten posts it can, or all it has.
    """
    model, asked = load_tag_model(spark, _stored_model(spark, sf)), V.questions(spark, sf).select("qid", "question")
    found = Q.answer_raw_questions(
        asked, model, V.posts(spark, sf), None, V.word_vectors(spark, sf), V.idf(spark, sf), V.DIM,
        search=Q.index_search(V.thread_index(spark, sf)))
    by_rank = F.array_sort(F.collect_list(F.struct("rank", F.negative("final_weight").alias("down"))))
    got = found.groupBy("qid").agg(by_rank.alias("r"), F.collect_set(F.regexp_extract("tags", "^<([^>]*)>", 1)).alias("langs"))
    sizes = V.thread_vectors(spark, sf).groupBy("tag").agg(F.least(F.count(F.lit(1)), F.lit(C.TOP_NEIGHBOURS)).alias("n"))
    tags = model.predict(asked).select("qid", F.explode("predicted.tag").alias("tag")).join(sizes, "tag", "left")
    due = tags.groupBy("qid").agg(F.sum("n").alias("n"), F.collect_set("tag").alias("predicted"))
    gapless = F.col("r.rank") == F.sequence(F.lit(1), F.size("r"))
    return got.join(due, "qid").select(
        "qid", (gapless & (F.array_sort("r.down") == F.col("r.down"))).alias("ranked"),
        (F.size(F.array_except("langs", "predicted")) == 0).alias("within"), (F.size("r") == F.col("n")).alias("whole"))


@query("m07_boosted_classifier", JUDGED)
def m07(spark, sf):
    """Few terms and shallow trees keep the registered run short; the operator's defaults are the full ones."""
    ready, _, _ = _labelled(spark, sf, vocab=64)
    model = M.fit_boosted_classifier(_train(ready), trees=3, depth=3)
    return _judged(model.transform(ready.withColumn("label", F.col("label").cast("double"))))


@query("m08_network_classifier", JUDGED)
def m08(spark, sf):
    """All terms that two documents hold, and the operator's own iterations."""
    ready, names, _ = _labelled(spark, sf)
    inputs = ready.select(F.col("features")).first()[0].size
    model = M.fit_network_classifier(_train(ready), inputs, len(names))
    return _judged(model.transform(ready.withColumn("label", F.col("label").cast("double"))))


@query("m09_trained_word_vectors", f"""WITH d AS (SELECT related_post_id, string_agg({S.search_text('title', False)}, ' ') AS newer FROM dup_pairs JOIN link_posts ON post_id = comment_id GROUP BY 1),
w AS (SELECT unnest(string_split_regex({S.search_text('p.title', False)} || ' ' || newer, '\\s+')) AS word FROM d JOIN link_posts p ON related_post_id = p.comment_id)
SELECT word, 100 AS dim FROM w WHERE word <> '' GROUP BY word HAVING count(*) >= 2""")
def m09(spark, sf):
    lines = P.build_duplicate_corpus(V.links(spark, sf), V.link_posts(spark, sf))
    tokens = lines.select(F.filter(F.split("value", r"\s+"), lambda w: w != "").alias("tokens"))
    return M.word_table(M.fit_word_vectors(tokens)).select("word", F.size("vec").alias("dim"))


@query("m10_document_vectors", "SELECT doc_id AS qid, count(*) OVER () * 0 + 3 AS found FROM documents")
def m10(spark, sf):
    docs = V.texts(spark, sf).select(F.col("doc_id").alias("comment_id"), search_tokens(F.col("text")).alias("tokens"))
    model = M.fit_word_vectors(docs)
    stored = V.written(M.document_vectors(model, docs, "comment_id"), "docvecs")
    found = nearest(stored.withColumnRenamed("comment_id", "qid"), stored, 3, "cosine")
    return found.groupBy("qid").agg(F.count("*").alias("found"))


# --- jobs -----------------------------------------------------------------------------------------

@query("p01_build_posts", f"""SELECT comment_id, parent_id, {S.storage_text('comment')} AS comment, {S.storage_text('title')} AS title,
CAST(date AS VARCHAR) AS date, score, {S.storage_tags('tags')} AS tags FROM posts WHERE score > 0""")
def p01(spark, sf):
    posts = P.build_posts(read_posts_dump(spark, posts_dump(spark, sf)))
    return posts.withColumn("date", F.col("date").cast("string"))


@query("p02_topic_subset", f"""WITH t AS (SELECT comment_id, parent_id, comment, title, score, {S.storage_tags('tags')} AS tags FROM posts),
kept AS (SELECT * FROM t WHERE list_has_any({S.space_tokens('tags')}, ['fr', 'src4'])),
subset AS (SELECT comment_id, parent_id, comment, title, score, tags FROM kept UNION ALL
  SELECT comment_id, parent_id, comment, NULL, score, NULL FROM t WHERE parent_id IN (SELECT comment_id FROM kept))
SELECT * FROM subset UNION ALL SELECT "Id", NULL, "Body", "Title", "Score", 'none' FROM csv_questions WHERE "Id" NOT IN (SELECT comment_id FROM subset)""")
def p02(spark, sf):
    posts = V.posts(spark, sf).drop("date").withColumn("tags", storage_tags(F.col("tags"), "common"))
    extra = csv_questions_as_posts(V.csv_questions(spark, sf).withColumn("Tag", F.lit("none")))
    return P.build_topic_subset(posts, extra, ["fr", "src4"])


@query("p03_labelled_titles", f"""WITH t AS (SELECT comment_id, {S.search_text('title')} AS title, {S.label_tag(S.storage_tags('tags'))} AS tag FROM posts WHERE parent_id IS NULL),
c AS (SELECT tag FROM (SELECT tag, count(*) AS n FROM t GROUP BY tag ORDER BY n DESC, tag LIMIT 3) WHERE tag <> 'none')
SELECT comment_id, title, CASE WHEN tag IN (SELECT tag FROM c) THEN tag ELSE 'other' END AS tag FROM t""")
def p03(spark, sf):
    posts = V.posts(spark, sf).withColumn("tags", storage_tags(F.col("tags"), "common"))
    return P.build_labelled_titles(posts, keep=3)


@query("p04_duplicate_corpus", f"""WITH d AS (SELECT related_post_id, string_agg({S.search_text('title', False)}, chr(9) ORDER BY post_id, {S.search_text('title', False)}) AS newer
  FROM dup_pairs JOIN link_posts ON post_id = comment_id GROUP BY 1)
SELECT related_post_id, {S.search_text('p.title', False)} || chr(9) || newer AS value FROM d JOIN link_posts p ON related_post_id = p.comment_id""")
def p04(spark, sf):
    return P.build_duplicate_corpus(V.links(spark, sf), V.link_posts(spark, sf))


@query("p07_training_pairs", f"""WITH best AS (SELECT parent_id, max({S.training_text('comment')}) AS comment, max(score) AS score FROM dialogue_posts WHERE parent_id IS NOT NULL GROUP BY parent_id),
t AS (SELECT b.parent_id, b.comment, b.score, {S.training_text('q.comment')} AS title FROM best b LEFT JOIN dialogue_posts q ON b.parent_id = q.comment_id)
SELECT parent_id, comment, score, title, {RANDOM.format('parent_id')} AS is_test FROM t WHERE score > 0 AND length(comment) > 100 AND length(title) > 20""")
def p07(spark, sf):
    return P.build_training_pairs(V.dialogue_posts(spark, sf), entities="common")


MARKED = S.fixed_text("chr(10) || 'xbos xfld 1 ' || question || ' xfld 1 ' || reply")


@query("p08_encoded_corpus", f"""WITH t AS (SELECT qid, {S.word_tokens(MARKED)} AS tokens FROM turn_pairs),
c AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM t) GROUP BY token),
v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS idx FROM c WHERE n > 2 ORDER BY n DESC, token LIMIT 60000),
f AS (SELECT qid, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS spot FROM t),
i AS (SELECT qid, list(coalesce(idx, 0) ORDER BY spot) AS ids FROM f LEFT JOIN v USING (token) GROUP BY qid)
SELECT qid, rtrim(repeat('1 ', greatest(200 - len(ids), 0)) || array_to_string(list_slice(ids, greatest(len(ids) - 199, 1), len(ids)), ' ')) AS ids FROM i""")
def p08(spark, sf):
    encoded, _ = P.encode_corpus(V.turn_pairs(spark, sf), "qid", "question", "reply", length=200, entities="common")
    return encoded.select("qid", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))
