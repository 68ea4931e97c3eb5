"""Stand-in tables: whole driver tables under the names and columns of a question-and-answer corpus.

Each view exists twice with the same arithmetic, as a DataFrame and as DuckDB SQL. No view leaves
out rows of its table unless its meaning says so (questions, answers, pairs of turns).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suite import sqltext as S
from threadloom.functions.text import search_text, search_tokens
from threadloom.functions.vectors import as_doubles
from threadloom.session import scratch_path, written
from threadloom.sources.tables import balanced
from threadloom.operators import index as vector_index
from threadloom.operators.embed import mean_vectors, weighted_words
from threadloom.operators.tfidf import term_idf, term_weights
from threadloom.plans.answers import question_vectors as vectors_of_questions
from threadloom.plans.answers import thread_vectors as vectors_of_threads

DIM = 64
LANGS = ("en", "fr", "de", "es")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, spread over the cores when their file is read as one split."""
    return balanced(table(spark, sf, "documents"))


_PREPARED: dict[tuple[str, str, str], DataFrame] = {}


def prepared(build):
    """Build a table once per session and read it back afterwards, as a search engine keeps its index.

    ``build`` itself stays reachable as ``.build`` for queries that are about the building.
    """

    def get(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf, build.__name__)
        if key not in _PREPARED:
            _PREPARED[key] = written(build(spark, sf), build.__name__)
        return _PREPARED[key]

    get.build = build
    return get


# --- DataFrames -----------------------------------------------------------------------------------

def posts(spark, sf):
    """Documents as posts: every fourth opens a thread, the three after it answer; the first line is the title."""
    d = table(spark, sf, "documents")
    root = F.col("doc_id") % 4 == 0
    return d.select(
        F.col("doc_id").alias("comment_id"),
        F.when(~root, F.col("doc_id") - F.col("doc_id") % 4).alias("parent_id"),
        F.col("text").alias("comment"),
        F.when(root, F.get(F.split("text", "\n"), F.lit(0))).alias("title"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int")).alias("date"),
        (F.col("n_chars") % 11 - 2).alias("score"),
        F.when(root, F.concat(F.lit("<"), "lang", F.lit("><"), "source", F.lit(">"))).alias("tags"),
    )


def links(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("post_id"), F.col("l_partkey").alias("related_post_id"),
        F.col("l_linenumber").cast("bigint").alias("link_type_id"),
    )


def link_posts(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("comment_id"),
        F.concat_ws(" ", F.lit("How to"), "o_orderpriority", "o_orderstatus", "o_custkey").alias("title"),
    )


def csv_questions(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("Id"),
        F.col("o_custkey").alias("OwnerUserId"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("CreationDate"),
        (F.col("o_custkey") % 13 - 2).alias("Score"),
        F.concat_ws(" ", F.lit("Order"), "o_orderpriority").alias("Title"),
        F.concat_ws(" ", F.lit("Status"), "o_orderstatus").alias("Body"),
    )


def csv_answers(spark, sf):
    return table(spark, sf, "lineitem").select(
        (F.lit(100000000) + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("Id"),
        F.col("l_orderkey").alias("ParentId"),
        (F.col("l_suppkey") % 7 - 1).alias("Score"),
        F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("Body"),
    )


def csv_tags(spark, sf):
    part = table(spark, sf, "part")
    return part.select(F.col("p_partkey").alias("Id"), F.col("p_brand").alias("Tag")).unionAll(
        part.select(F.col("p_partkey").alias("Id"), F.col("p_type").alias("Tag"))
    )


def questions(spark, sf):
    tag = F.element_at(F.array(*[F.lit(x) for x in LANGS]), (F.col("item_id") % 4 + 1).cast("int"))
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("question"), tag.alias("tag")
    )


def predicted(spark, sf):
    """Questions with two predicted tags each, in place of a classifier's answer."""
    names = F.array(*[F.lit(x) for x in LANGS])
    first = F.element_at(names, (F.col("qid") % 4 + 1).cast("int"))
    second = F.element_at(names, ((F.col("qid") + 1) % 4 + 1).cast("int"))
    pair = F.array(
        F.struct(first.alias("tag"), F.lit(0.6).alias("score")), F.struct(second.alias("tag"), F.lit(0.3).alias("score"))
    )
    return questions(spark, sf).select("qid", "question", pair.alias("predicted"))


@prepared
def search_words(spark, sf):
    """Every document with its different search words, cleaned once for the tables below."""
    return texts(spark, sf).select("doc_id", F.array_distinct(search_tokens(F.col("text"))).alias("words"))


@prepared
def distinct_words(spark, sf):
    """Every search word of the documents once."""
    return search_words(spark, sf).select(F.explode("words").alias("word")).distinct()


def _word_slots(spark, sf):
    """Every search word of the documents with a hash slot out of four times the number of vectors."""
    words = distinct_words(spark, sf)
    n = table(spark, sf, "embeddings").select(F.count(F.lit(1)).alias("n")).scalar()
    slot = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint") % (4 * n)
    return words.select("word", slot.alias("slot")), n


@prepared
def word_vectors(spark, sf):
    """The words of the first quarter of the slots have a vector."""
    slots, _ = _word_slots(spark, sf)
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("slot"), as_doubles(F.col("embedding")).alias("vec"))
    return slots.join(vectors, "slot").select("word", "vec")


@prepared
def spare_vectors(spark, sf):
    """The words of the second quarter have one in the auxiliary table only."""
    slots, n = _word_slots(spark, sf)
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("slot"), as_doubles(F.col("embedding")).alias("vec"))
    return slots.withColumn("slot", F.col("slot") - n).join(vectors, "slot").select("word", "vec")


@prepared
def idf(spark, sf):
    docs = search_words(spark, sf).select(F.array_join("words", " ").alias("text"))  # a text counts once per term
    return term_idf(docs, "text", min_df=2)


@prepared
def thread_vectors(spark, sf):
    lang = F.regexp_extract("tags", "^<([^>]*)>", 1)
    return vectors_of_threads(balanced(posts(spark, sf)), "comment", lang, word_vectors(spark, sf), idf(spark, sf), DIM)


@prepared
def doc_weights(spark, sf):
    """Term weights of the documents, kept like the index of a search engine."""
    docs = texts(spark, sf).select("doc_id", search_text(F.col("text")).alias("text"))
    return term_weights(docs, ["doc_id"], "text", idf(spark, sf))


def stored_index(build):
    """Write a vector index once per session; every query loads it from its folder."""
    folders: dict[tuple[str, str], str] = {}

    def get(spark: SparkSession, sf: str):
        key = (spark.sparkContext.applicationId, sf)
        if key not in folders:
            folders[key] = scratch_path(spark, build.__name__)
            vector_index.build(build(spark, sf), folders[key])
        return vector_index.load(spark, folders[key])

    return get


@stored_index
def thread_index(spark, sf):
    return thread_vectors(spark, sf)


@stored_index
def labelled_index(spark, sf):
    return labelled_vectors(spark, sf)


def question_vectors(spark, sf):
    return vectors_of_questions(questions(spark, sf), word_vectors(spark, sf), idf(spark, sf), DIM)


def labelled_vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("tag"), F.col("vec_id").alias("comment_id"), as_doubles(F.col("embedding")).alias("vec")
    )


@prepared
def title_vectors(spark, sf):
    asked = posts(spark, sf).where("parent_id is null")
    cleaned = asked.select(
        F.regexp_extract("tags", "^<([^>]*)>", 1).alias("tag"), "comment_id", search_text(F.col("title")).alias("text")
    )
    return mean_vectors(cleaned, ["tag", "comment_id"], "text", weighted_words(word_vectors(spark, sf), idf(spark, sf)), DIM)


def turn_pairs(spark, sf):
    """User turns and the assistant turn right after each."""
    c = table(spark, sf, "conversations")
    ask = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return ask.join(reply, ["conv_id", "turn"]).withColumn("qid", F.col("conv_id") * 100 + F.col("turn"))


@prepared
def reply_vectors(spark, sf):
    """Every reply of a turn pair, in one group."""
    texts_ = turn_pairs(spark, sf).select(F.lit("replies").alias("tag"), F.col("qid").alias("comment_id"), search_text(F.col("reply")).alias("text"))
    return mean_vectors(texts_, ["tag", "comment_id"], "text", weighted_words(word_vectors(spark, sf), idf(spark, sf)), DIM)


@stored_index
def reply_index(spark, sf):
    return reply_vectors(spark, sf)


def cases(spark, sf):
    """A question, its reply, then the first replies of the nine conversations that follow."""
    pairs = turn_pairs(spark, sf)
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("other"))
    wanted = pairs.select("qid", F.explode(F.sequence(F.col("conv_id") + 1, F.col("conv_id") + 9)).alias("conv_id"))
    others = wanted.join(first, "conv_id").groupBy("qid").agg(
        F.sort_array(F.collect_list(F.struct("conv_id", "other"))).alias("others")
    )
    none = F.array().cast("array<string>")
    return pairs.join(others, "qid", "left").select(
        "qid", "question", F.concat(F.array("reply"), F.coalesce(F.col("others")["other"], none)).alias("cands")
    )


def dialogue_posts(spark, sf):
    """Turn pairs as posts: user turns ask, the following assistant turns answer."""
    p = turn_pairs(spark, sf)
    none = F.lit(None)
    ask = p.select(F.col("qid").alias("comment_id"), none.cast("bigint").alias("parent_id"), F.col("question").alias("comment"),
                   (F.length("question").cast("bigint") % 7 - 1).alias("score"))
    reply = p.select((F.col("qid") + 1000000000).alias("comment_id"), F.col("qid").alias("parent_id"), F.col("reply").alias("comment"),
                     (F.length("reply").cast("bigint") % 7 - 1).alias("score"))
    return ask.unionAll(reply)


# --- SQL ------------------------------------------------------------------------------------------

def sql_mean(name: str, keys: str, texts: str, tokens: str, words: str) -> str:
    """CTEs ``name``(keys, vec): mean of weight * vec over the known tokens of ``texts``."""
    on = [k.strip() for k in keys.split(",")]
    zeros = f"list_transform(range({DIM}), lambda i: 0.0::DOUBLE)"
    join = " AND ".join(f"b.{k} = v.{k}" for k in on)
    return f"""{name}_tok AS (SELECT {keys}, unnest({tokens}) AS word FROM {texts}),
{name}_hit AS (SELECT {", ".join("t." + k for k in on)}, w.vec, w.weight FROM {name}_tok t JOIN {words} w ON t.word = w.word),
{name}_sum AS (SELECT {keys}, elt, sum(v * weight) / count(*) AS x FROM (
  SELECT {keys}, weight, unnest(vec) AS v, generate_subscripts(vec, 1) AS elt FROM {name}_hit) GROUP BY {keys}, elt),
{name}_vec AS (SELECT {keys}, list(x ORDER BY elt) AS vec FROM {name}_sum GROUP BY {keys}),
{name} AS (SELECT {", ".join("b." + k for k in on)}, coalesce(v.vec, {zeros}) AS vec FROM {texts} b LEFT JOIN {name}_vec v ON {join})"""


WS = "list_filter(string_split(lower(text), ' '), lambda w: w <> '')"
_LANG_LIST = "['en','fr','de','es']"

VIEWS: dict[str, str] = {
    "posts": """posts AS (SELECT doc_id AS comment_id, CASE WHEN doc_id % 4 <> 0 THEN doc_id - doc_id % 4 END AS parent_id,
  text AS comment, CASE WHEN doc_id % 4 = 0 THEN string_split(text, chr(10))[1] END AS title,
  DATE '2020-01-01' + (doc_id % 1000)::INTEGER AS date, n_chars % 11 - 2 AS score,
  CASE WHEN doc_id % 4 = 0 THEN '<' || lang || '><' || source || '>' END AS tags FROM documents)""",
    "links": """links AS (SELECT l_orderkey AS post_id, l_partkey AS related_post_id, l_linenumber AS link_type_id FROM lineitem)""",
    "link_posts": """link_posts AS (SELECT o_orderkey AS comment_id,
  concat_ws(' ', 'How to', o_orderpriority, o_orderstatus, o_custkey) AS title FROM orders)""",
    "dup_pairs": """dup_pairs AS (SELECT post_id, related_post_id FROM links WHERE link_type_id = 3 AND post_id > related_post_id
  AND post_id IN (SELECT comment_id FROM link_posts) AND related_post_id IN (SELECT comment_id FROM link_posts))""",
    "csv_questions": """csv_questions AS (SELECT o_orderkey AS "Id", o_custkey AS "OwnerUserId",
  strftime(o_orderdate, '%Y-%m-%d') AS "CreationDate", o_custkey % 13 - 2 AS "Score",
  'Order ' || o_orderpriority AS "Title", 'Status ' || o_orderstatus AS "Body" FROM orders)""",
    "csv_answers": """csv_answers AS (SELECT 100000000 + l_orderkey * 10 + l_linenumber AS "Id", l_orderkey AS "ParentId",
  l_suppkey % 7 - 1 AS "Score", l_returnflag || ' ' || l_linestatus AS "Body" FROM lineitem)""",
    "csv_tags": """csv_tags AS (SELECT p_partkey AS "Id", p_brand AS "Tag" FROM part UNION ALL SELECT p_partkey, p_type FROM part)""",
    "questions": f"""questions AS (SELECT item_id AS qid, text AS question, {_LANG_LIST}[item_id % 4 + 1] AS tag FROM benchmark)""",
    "predicted": f"""predicted AS (SELECT item_id AS qid, text AS question, {_LANG_LIST}[item_id % 4 + 1] AS tag1,
  {_LANG_LIST}[(item_id + 1) % 4 + 1] AS tag2, 0.6::DOUBLE AS score1, 0.3::DOUBLE AS score2 FROM benchmark)""",
    "doc_tokens": f"""doc_tokens AS (SELECT doc_id, {S.search_tokens("text")} AS tokens FROM documents)""",
    "word_slots": """word_slots AS (SELECT word, ('0x' || substr(md5(word), 1, 8))::BIGINT % (4 * n) AS slot, n
  FROM (SELECT DISTINCT unnest(tokens) AS word FROM doc_tokens), (SELECT count(*) AS n FROM embeddings))""",
    "word_vectors": """word_vectors AS (SELECT word, embedding::DOUBLE[] AS vec FROM word_slots JOIN embeddings ON vec_id = slot)""",
    "spare_vectors": """spare_vectors AS (SELECT word, embedding::DOUBLE[] AS vec FROM word_slots JOIN embeddings ON vec_id = slot - n)""",
    "idf": """idf AS (SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM
  (SELECT term, count(*)::DOUBLE AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM doc_tokens) GROUP BY term),
  (SELECT count(*)::DOUBLE AS n FROM documents) WHERE df >= 2 AND df <= 0.9 * n)""",
    "plain_words": """plain_words AS (SELECT word, vec, 1.0::DOUBLE AS weight FROM word_vectors)""",
    "idf_words": """idf_words AS (SELECT w.word, w.vec, coalesce(i.idf, 0) AS weight FROM word_vectors w LEFT JOIN idf i ON w.word = i.term)""",
    "thread_texts": f"""thread_texts AS (SELECT regexp_extract(tags, '^<([^>]*)>', 1) AS tag, comment_id, {S.search_text("comment")} AS text
  FROM posts WHERE parent_id IS NULL)""",
    "thread_vectors": sql_mean("thread_vectors", "tag, comment_id", "thread_texts", WS, "idf_words"),
    "title_texts": f"""title_texts AS (SELECT regexp_extract(tags, '^<([^>]*)>', 1) AS tag, comment_id, {S.search_text("title")} AS text
  FROM posts WHERE parent_id IS NULL)""",
    "title_vectors": sql_mean("title_vectors", "tag, comment_id", "title_texts", WS, "idf_words"),
    "question_texts": f"""question_texts AS (SELECT qid, {S.search_text("question")} AS text FROM questions)""",
    "question_vectors": sql_mean("question_vectors", "qid", "question_texts", WS, "idf_words"),
    "labelled_vectors": """labelled_vectors AS (SELECT label AS tag, vec_id AS comment_id, embedding::DOUBLE[] AS vec FROM embeddings)""",
    "turn_pairs": """turn_pairs AS (SELECT a.conv_id, a.turn, a.conv_id * 100 + a.turn AS qid, a.text AS question, b.text AS reply
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')""",
    "first_replies": """first_replies AS (SELECT conv_id, arg_min(text, turn) AS other FROM conversations WHERE role = 'assistant' GROUP BY conv_id)""",
    "case_cands": """case_cands AS (SELECT qid, 0 AS pos, reply AS cand FROM turn_pairs UNION ALL
  SELECT p.qid, row_number() OVER (PARTITION BY p.qid ORDER BY f.conv_id) AS pos, f.other AS cand
  FROM turn_pairs p JOIN first_replies f ON f.conv_id BETWEEN p.conv_id + 1 AND p.conv_id + 9)""",
    "dialogue_posts": """dialogue_posts AS (SELECT qid AS comment_id, NULL::BIGINT AS parent_id, question AS comment,
  length(question) % 7 - 1 AS score FROM turn_pairs UNION ALL
  SELECT qid + 1000000000, qid, reply, length(reply) % 7 - 1 FROM turn_pairs)""",
}


def _needs(sql: str) -> list[str]:
    return [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]


def with_views(sql: str) -> str:
    """``sql`` with the CTEs of every view it uses, in dependency order."""
    placed: list[str] = []

    def place(text: str, own: str = "") -> None:
        for name in _needs(text):
            if name != own and name not in placed:
                place(VIEWS[name], name)
                if name not in placed:
                    placed.append(name)

    place(sql)
    if not placed:
        return sql
    head = ",\n".join(VIEWS[name] for name in placed)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
