"""Text functions, tokens and encodings on whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import sqltext as S
from suite import views as V
from suite.registry import query
from threadloom.functions import constants as C
from threadloom.functions import text as T
from threadloom.operators.fuzzy import best_matches
from threadloom.operators.aggregates import token_vocabulary
from threadloom.operators.encode import numericalised, padded_sequences
from threadloom.operators.models import canonical_tags, rare_as_other
from threadloom.operators.ranking import top_k
from threadloom.session import placed


def _register(name, table, key, column, spark_form, sql_form):
    """A text form over a whole column of a whole table."""

    @query(name, f"SELECT {key}, {sql_form(column)} AS value FROM {table}")
    def run(spark, sf):
        return V.balanced(V.table(spark, sf, table)).select(key, spark_form(F.col(column)).alias("value"))


DOCS = ("documents", "doc_id", "text")
PAGES = ("pages", "page_id", "html")

_register("t01_search_text", *DOCS, T.search_text, S.search_text)
_register("t01_search_text_of_pages", *PAGES, T.search_text, S.search_text)
_register("t02_prepared_text", *DOCS, T.prepared_text, lambda e: S.search_text(e, False))
_register("t03_storage_text", *PAGES, T.storage_text, S.storage_text)
_register("t03_storage_text_dropped_markup", *PAGES,
          lambda c: T.storage_text(c, "drop", "space", "common"), lambda e: S.storage_text(e, "drop", "space"))
_register("t03_storage_text_marked_lines", *DOCS,
          lambda c: T.storage_text(c, "drop", "marker", "common"), lambda e: S.storage_text(e, "drop", "marker"))
_register("t04_alphanumeric_text", *PAGES, T.alphanumeric_text, S.alphanumeric)
_register("t05_unescaped_common", *PAGES, T.unescape_common, S.unescape)
_register("t05_unescaped_all", *PAGES, T.unescape_all, S.unescape)
_register("t06_training_text", *PAGES, lambda c: T.training_text(c, "common"), S.training_text)
_register("t07_fixed_text", *PAGES, lambda c: T.fixed_text(c, "common"), S.fixed_text)
_register("t07_flattened_text", *PAGES, lambda c: T.flattened_text(c, "common"), S.flattened)
_register("t08_html_text", *PAGES, lambda c: T.html_text(c, "common"), S.html_text)


@query("t09_storage_tags", f"SELECT comment_id, {S.storage_tags('tags')} AS value FROM posts WHERE tags IS NOT NULL")
def t09(spark, sf):
    posts = V.posts(spark, sf).where("tags is not null")
    return posts.select("comment_id", T.storage_tags(F.col("tags")).alias("value"))


@query("t10_label_tag", f"""SELECT p_partkey, {S.label_tag("p_name || ' ' || p_brand")} AS plain, {S.label_tag("p_brand || ' ' || p_name", True)} AS digits FROM part""")
def t10(spark, sf):
    part = V.table(spark, sf, "part")
    return part.select(
        "p_partkey",
        T.label_tag(F.concat_ws(" ", "p_name", "p_brand")).alias("plain"),
        T.label_tag(F.concat_ws(" ", "p_brand", "p_name"), digits=True).alias("digits"),
    )


GROUPS = ", ".join(f"({S.lit(raw)}, {S.lit(name)})" for name, raws in C.TAG_GROUPS.items() for raw in raws)
RAW = [raw for raws in C.TAG_GROUPS.values() for raw in raws] + ["none", "cobol", "fortran"]
RAW_SQL = "[" + ", ".join(S.lit(r) for r in RAW) + "]"


def _raw_tags(spark, sf):
    names = F.array(*[F.lit(r) for r in RAW])
    at = (F.col("o_custkey") * 7 + F.col("o_orderkey")) % len(RAW)
    return V.table(spark, sf, "orders").select("o_orderkey", F.get(names, at.cast("int")).alias("tag"))


RAW_TAGS = f"raw_tags AS (SELECT o_orderkey, {RAW_SQL}[(o_custkey * 7 + o_orderkey) % {len(RAW)} + 1] AS tag FROM orders)"
CANON = f"""{RAW_TAGS}, groups(raw, name) AS (VALUES {GROUPS}),
canon AS (SELECT o_orderkey, coalesce(g.name, r.tag) AS tag FROM raw_tags r LEFT JOIN groups g ON r.tag = g.raw)"""


@query("t11_canonical_tags", f"WITH {CANON} SELECT o_orderkey, tag FROM canon")
def t11(spark, sf):
    return canonical_tags(_raw_tags(spark, sf)).select("o_orderkey", "tag")


@query("t12_rare_as_other", f"""WITH {CANON}, common AS (SELECT tag FROM (SELECT tag, count(*) AS n FROM canon GROUP BY tag ORDER BY n DESC, tag LIMIT 10) WHERE tag <> 'none')
SELECT o_orderkey, CASE WHEN tag IN (SELECT tag FROM common) THEN tag ELSE 'other' END AS tag FROM canon""")
def t12(spark, sf):
    return rare_as_other(canonical_tags(_raw_tags(spark, sf)), keep=10).select("o_orderkey", "tag")


@query("t13_whitespace_tokens", f"""SELECT word, count(*) AS n FROM (SELECT unnest({S.space_tokens("lower(text)")}) AS word FROM documents) GROUP BY word""")
def t13(spark, sf):
    words = V.texts(spark, sf).select(F.explode(T.whitespace_tokens(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


@query("t14_word_tokens", f"""SELECT doc_id, array_to_string({S.word_tokens("text")}, ' ') AS value FROM documents""")
def t14(spark, sf):
    return V.texts(spark, sf).select("doc_id", F.array_join(T.word_tokens(F.col("text")), " ").alias("value"))


@query("t15_marked_fields", """SELECT qid, chr(10) || 'xbos xfld 1 ' || question || ' xfld 1 ' || reply || ' xfld 2 ' || conv_id::VARCHAR AS value FROM turn_pairs""")
def t15(spark, sf):
    marked = T.marked_fields(F.col("question"), F.col("reply"), F.col("conv_id").cast("string"))
    return V.turn_pairs(spark, sf).select("qid", marked.alias("value"))


VOCAB = f"""vt AS (SELECT doc_id, {S.word_tokens("text")} AS tokens FROM documents),
counts AS (SELECT token, count(*) AS count FROM (SELECT unnest(tokens) AS token FROM vt) GROUP BY token),
vocab AS (SELECT token, count, row_number() OVER (ORDER BY count DESC, token) + 1 AS idx FROM counts WHERE count > 2 ORDER BY count DESC, token LIMIT 2000)"""


def _doc_tokens(spark, sf):
    return V.texts(spark, sf).select("doc_id", T.word_tokens(F.col("text")).alias("tokens"))


def _vocabulary(spark, sf, most=2000):
    tokens = _doc_tokens(spark, sf).select(F.explode("tokens").alias("token"))
    return token_vocabulary(tokens, max_vocab=most, min_freq=2, specials=C.SHORT_SPECIALS)


#: The operator's own limit, for the queries over the full vocabulary.
FULL = 60_000


def full(sql: str) -> str:
    return sql.replace("LIMIT 2000", f"LIMIT {FULL}")


A10 = f"WITH {VOCAB} SELECT token, count, idx FROM vocab UNION ALL VALUES ('_unk_', 0, 0), ('_pad_', 0, 1)"


@query("a10_token_vocabulary", A10)
def a10(spark, sf):
    return _vocabulary(spark, sf).withColumn("idx", F.col("idx").cast("bigint"))


@query("a10_full_vocabulary", full(A10))
def a10_full(spark, sf):
    return _vocabulary(spark, sf, FULL).withColumn("idx", F.col("idx").cast("bigint"))


IDS = f"""{VOCAB}, flat AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS spot FROM vt),
ids AS (SELECT doc_id, list(coalesce(idx, 0) ORDER BY spot) AS ids FROM flat LEFT JOIN vocab USING (token) GROUP BY doc_id)"""


T16 = f"WITH {IDS} SELECT doc_id, array_to_string(ids, ' ') AS ids FROM ids"


def _numericalised(spark, sf, most):
    return numericalised(_doc_tokens(spark, sf), "doc_id", "tokens", _vocabulary(spark, sf, most))


def _id_texts(encoded):
    return encoded.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("t16_numericalised", T16)
def t16(spark, sf):
    return _id_texts(_numericalised(spark, sf, 2000))


@query("t16_full_vocabulary", full(T16))
def t16_full(spark, sf):
    return _id_texts(_numericalised(spark, sf, FULL))


T17 = f"""WITH {IDS}, cut AS (SELECT doc_id, list_slice(ids, greatest(len(ids) - 299, 1), len(ids)) AS ids FROM ids)
SELECT doc_id, rtrim(repeat('1 ', 300 - len(ids)) || array_to_string(ids, ' ')) AS pre, rtrim(array_to_string(ids, ' ') || repeat(' 1', 300 - len(ids))) AS post FROM cut"""


def _padded_texts(encoded):
    def joined(side):
        return F.array_join(T.padded(F.col("ids"), 300, side).cast("array<string>"), " ").alias(side)

    return encoded.select("doc_id", joined("pre"), joined("post"))


@query("t17_padded", T17)
def t17(spark, sf):
    return _padded_texts(_numericalised(spark, sf, 2000))


@query("t17_full_vocabulary", full(T17))
def t17_full(spark, sf):
    return _padded_texts(_numericalised(spark, sf, FULL))


@query("t18_shares_word", f"""SELECT qid, list_has_any({S.space_tokens("reply")}, {S.space_tokens("question")}) AS shares FROM turn_pairs""")
def t18(spark, sf):
    return V.turn_pairs(spark, sf).select("qid", T.shares_word(F.col("reply"), F.col("question")).alias("shares"))


SIMILARITY = "CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE END"


@query("t19_best_match_by_edits", f"""WITH pairs AS (SELECT qid, pos, {S.search_text("cand")} AS a, {S.search_text("question")} AS b FROM case_cands JOIN (SELECT qid, question FROM turn_pairs) USING (qid)),
scored AS (SELECT qid, pos, round({SIMILARITY}, 6) AS score FROM pairs)
SELECT qid, pos, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS rank FROM scored) WHERE rank <= 3""")
def t19(spark, sf):
    spread = placed(V.cases(spark, sf).select("qid", "question", F.posexplode("cands").alias("pos", "cand")), "qid", "pos")
    score = T.similarity_by_edits(T.search_text(F.col("cand")), T.search_text(F.col("question")))
    scored = spread.select("qid", F.col("pos").cast("bigint").alias("pos"), F.round(score, 6).alias("score"))
    return top_k(scored, ["qid"], [F.desc("score"), F.asc("pos")], 3)


FIRST_LINES = f"""lines AS (SELECT doc_id, {S.search_text("line")} AS line FROM (SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents) AS f)"""


@query("t19_corpus_matches", f"""WITH {FIRST_LINES}, pairs AS (SELECT x.doc_id AS qid, y.doc_id, x.line AS a, y.line AS b FROM lines x JOIN lines y
  ON x.doc_id % 20 = 0 AND abs(length(x.line) - length(y.line)) <= 0.2 * greatest(length(x.line), length(y.line)) + 1e-9),
scored AS (SELECT qid, doc_id, round({SIMILARITY}, 6) AS score FROM pairs)
SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score >= 0.8) WHERE rank <= 5""")
def t19_corpus(spark, sf):
    """The five first lines of all documents most similar to those of every twentieth."""
    lines = V.texts(spark, sf).select("doc_id", T.search_text(F.get(F.split("text", "\n"), F.lit(0))).alias("text"))
    return best_matches(lines.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid"), lines, 5, 0.8, item="doc_id")


@query("t20_char_ngrams", f"""WITH {S.grams_cte("g", "doc_id", "documents", "text")} SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def t20(spark, sf):
    grams = V.texts(spark, sf).select(F.explode(T.char_ngrams(F.col("text"))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@query("t21_replaced_literals", f"""SELECT page_id, {S.swap("lower(html)", C.SEARCH_REPLACEMENTS)} AS value FROM pages""")
def t21(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", T.search_literals(F.lower("html")).alias("value"))


@query("t22_tag_confidence", """SELECT comment_id, qid, CASE WHEN contains(replace(tags, '-', '_'), tag1) THEN score1
WHEN contains(replace(tags, '-', '_'), tag2) THEN score2 ELSE 0.0 END AS confidence
FROM posts JOIN predicted ON comment_id = qid WHERE parent_id IS NULL""")
def t22(spark, sf):
    posts = V.posts(spark, sf).where("parent_id is null")
    both = posts.join(V.predicted(spark, sf), F.col("comment_id") == F.col("qid"))
    return both.select("comment_id", "qid", T.tag_confidence(F.col("tags"), F.col("predicted")).alias("confidence"))


@query("t23_scored_answer", "SELECT comment_id, comment || '::' || score::VARCHAR AS value FROM posts")
def t23(spark, sf):
    return V.posts(spark, sf).select("comment_id", T.scored_answer(F.col("comment"), F.col("score")).alias("value"))
