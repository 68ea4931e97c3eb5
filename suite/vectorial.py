"""Vectors, neighbours, candidate ranking, term weights, features and metrics."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from suite import sqltext as S
from suite import views as V
from suite.registry import query
from threadloom.functions import constants as C
from threadloom.functions.text import alphanumeric_text, search_text
from threadloom.operators import embed as E
from threadloom.operators import index as X
from threadloom.operators import joins as J
from threadloom.operators import metrics as M
from threadloom.operators import neighbours as N
from threadloom.operators import ranking as R
from threadloom.operators import rerank as W
from threadloom.operators import tfidf as I
from threadloom.operators import weights as L
from threadloom.plans import answers as Q
from threadloom.operators.aggregates import min_max_scaled, token_vocabulary
from threadloom.functions.text import search_tokens
from threadloom.session import written


def entries(df, *keys):
    """Vectors as rows (keys, pos, x), rounded."""
    return df.select(*keys, F.posexplode("vec").alias("pos", "v")).select(
        *keys, F.col("pos").cast("bigint").alias("pos"), F.round("v", 6).alias("x")
    )


def entries_sql(view: str, keys: str) -> str:
    return f"SELECT {keys}, pos - 1 AS pos, {S.r6('v')} AS x FROM (SELECT {keys}, unnest(vec) AS v, generate_subscripts(vec, 1) AS pos FROM {view})"


DOC_TEXTS = f"dtx AS (SELECT doc_id, {S.search_text('text')} AS text FROM documents)"


@query("v01_average_vectors", f"WITH {DOC_TEXTS}, {V.sql_mean('dv', 'doc_id', 'dtx', V.WS, 'plain_words')} {entries_sql('dv', 'doc_id')}")
def v01(spark, sf):
    docs = V.texts(spark, sf).select("doc_id", search_text(F.col("text")).alias("text"))
    return entries(E.average_vectors(docs, ["doc_id"], "text", V.word_vectors(spark, sf), V.DIM), "doc_id")


@query("v02_idf_vectors", entries_sql("question_vectors", "qid"))
def v02(spark, sf):
    return entries(V.question_vectors(spark, sf), "qid")


FALLBACK = """qw AS (SELECT DISTINCT unnest(list_filter(string_split(text, ' '), lambda w: w <> '')) AS word FROM question_texts),
borrowed AS (SELECT word, vec FROM (SELECT s.word, k.vec, row_number() OVER (PARTITION BY s.word ORDER BY round(list_inner_product(s.vec, k.vec), 6) DESC, k.word) AS r
  FROM (SELECT * FROM spare_vectors WHERE word IN (SELECT word FROM qw)) s, word_vectors k) WHERE r = 1),
every AS (SELECT word, vec FROM word_vectors UNION ALL SELECT word, vec FROM borrowed)"""


def _question_texts(spark, sf):
    return V.questions(spark, sf).select("qid", search_text(F.col("question")).alias("text"))


@query("v03_average_with_fallback", f"""WITH {FALLBACK}, ew AS (SELECT word, vec, 1.0::DOUBLE AS weight FROM every),
{V.sql_mean('qv', 'qid', 'question_texts', V.WS, 'ew')} {entries_sql('qv', 'qid')}""")
def v03(spark, sf):
    vectors = E.average_vectors_with_fallback(
        _question_texts(spark, sf), ["qid"], "text", V.word_vectors(spark, sf), V.spare_vectors(spark, sf), V.DIM)
    return entries(vectors, "qid")


@query("v04_idf_with_fallback", f"""WITH {FALLBACK}, ew AS (SELECT e.word, e.vec, CASE WHEN coalesce(i.idf, 0) = 0 THEN 1 ELSE i.idf END AS weight FROM every e LEFT JOIN idf i ON e.word = i.term),
{V.sql_mean('qv', 'qid', 'question_texts', V.WS, 'ew')} {entries_sql('qv', 'qid')}""")
def v04(spark, sf):
    vectors = E.idf_vectors_with_fallback(
        _question_texts(spark, sf), ["qid"], "text", V.word_vectors(spark, sf), V.spare_vectors(spark, sf), V.idf(spark, sf), V.DIM)
    return entries(vectors, "qid")


@query("v05_thread_vectors", entries_sql("thread_vectors", "tag, comment_id"))
def v05(spark, sf):
    return entries(V.thread_vectors.build(spark, sf), "tag", "comment_id")


@query("v06_body_vectors", f"""WITH ptx AS (SELECT page_id, {S.alphanumeric('html')} AS text FROM pages),
{V.sql_mean('pv', 'page_id', 'ptx', V.WS, 'plain_words')} {entries_sql('pv', 'page_id')}""")
def v06(spark, sf):
    pages = V.table(spark, sf, "pages").select("page_id", alphanumeric_text(F.col("html")).alias("text"))
    return entries(E.average_vectors(pages, ["page_id"], "text", V.word_vectors(spark, sf), V.DIM), "page_id")


# --- neighbours -----------------------------------------------------------------------------------

NORMED = "list_inner_product({0}, {0})"
COS = "CASE WHEN {n0} = 0 OR {n1} = 0 THEN 0 ELSE list_inner_product(a.vec, b.vec) / sqrt({n0} * {n1}) END".format(
    n0=NORMED.format("a.vec"), n1=NORMED.format("b.vec"))
BITS = "list_transform({0}, lambda x: CASE WHEN x > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
DISTANCE = {
    "angular": f"sqrt(2 * (1 - least(greatest({COS}, -1), 1)))",
    "euclidean": "list_distance(a.vec, b.vec)",
    "manhattan": "list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: abs(p[1] - p[2])))",
    "hamming": f"list_distance({BITS.format('a.vec')}, {BITS.format('b.vec')}) ** 2",
    "dot": "list_inner_product(a.vec, b.vec)",
}


def nearest_sql(metric: str, asked: str, stored: str, question: str, k: int) -> str:
    """The k nearest rows of ``stored`` within the tag of each row of ``asked``."""
    way = "DESC" if metric == "dot" else "ASC"
    return f"""SELECT qid, tag, comment_id, distances, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, tag ORDER BY distances {way}, comment_id) AS rank FROM
(SELECT a.{question} AS qid, a.tag, b.comment_id, {S.r6(DISTANCE[metric])} AS distances FROM {asked} a JOIN {stored} b ON a.tag = b.tag)) WHERE rank <= {k}"""


def _nearest(metric):
    @query(f"v07_nearest_{metric}", nearest_sql(metric, "labelled_vectors", "labelled_vectors", "comment_id", 5))
    def run(spark, sf):
        stored = V.labelled_vectors(spark, sf)
        return N.nearest(stored.withColumnRenamed("comment_id", "qid"), stored, 5, metric, group="tag")


for _metric in DISTANCE:
    _nearest(_metric)

TAGGED = "tagged AS (SELECT v.qid, q.tag, v.vec FROM question_vectors v JOIN questions q ON v.qid = q.qid)"


def _tagged(spark, sf):
    return V.question_vectors(spark, sf).join(V.questions(spark, sf).select("qid", "tag"), "qid")


@query("w03_neighbours_per_tag", f"WITH {TAGGED} {nearest_sql('angular', 'tagged', 'thread_vectors', 'qid', 10)}")
def w03(spark, sf):
    return X.search(_tagged(spark, sf), V.thread_index(spark, sf), 10)


@query("v07_stored_blocks", nearest_sql("angular", "labelled_vectors", "labelled_vectors", "comment_id", 5))
def v07_stored(spark, sf):
    asked = V.labelled_vectors(spark, sf).withColumnRenamed("comment_id", "qid")
    return X.search(asked, V.labelled_index(spark, sf), 5)


@query("v08_stored_index", """WITH n AS (SELECT tag, count(*) AS n FROM labelled_vectors GROUP BY tag)
SELECT tag, n * least(6, n) AS rows, TRUE AS recalled, TRUE AS few_read FROM n""")
def v08_stored(spark, sf):
    """Rows per tag, whether nine tenths of the five nearest others are found, and a tenth of a tag read at most (six at least)."""
    asked, index = V.labelled_vectors(spark, sf).withColumnRenamed("comment_id", "qid"), V.labelled_index(spark, sf)
    found = written(X.coded_search(asked, index, 6), "coded")
    exact = X.search(asked, index, 6).where("qid <> comment_id").select("qid", "tag", "comment_id")
    hits = found.select("qid", "tag", "comment_id", F.lit(1).alias("hit"))
    share = exact.join(hits, ["qid", "tag", "comment_id"], "left").groupBy("tag").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
    rows = found.groupBy("tag").agg(F.count(F.lit(1)).alias("rows"), F.max("scored").alias("read"))
    sizes = V.labelled_vectors(spark, sf).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    few = F.col("read") <= F.greatest(F.lit(6), F.floor(F.col("n") * 0.1))
    return rows.join(share, "tag").join(sizes, "tag").select("tag", "rows", (F.col("share") >= 0.9).alias("recalled"), few.alias("few_read"))


@query("v08_approximate_neighbours", """WITH n AS (SELECT tag, count(*) AS n FROM labelled_vectors GROUP BY tag)
SELECT tag, n * least(6, n) AS rows, TRUE AS recalled FROM n""")
def v08(spark, sf):
    """Rows per tag, and whether four fifths of the five nearest others are found."""
    stored = V.labelled_vectors(spark, sf)
    asked = stored.withColumnRenamed("comment_id", "qid")
    found = written(N.approximate_nearest(asked, stored, 6), "approximate")
    exact = N.nearest(asked, stored, 6, group="tag").where("qid <> comment_id")
    hits = found.select("qid", "tag", "comment_id", F.lit(1).alias("hit"))
    share = exact.join(hits, ["qid", "tag", "comment_id"], "left").groupBy("tag").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
    rows = found.groupBy("tag").agg(F.count(F.lit(1)).alias("rows"))
    return rows.join(share, "tag").select("tag", "rows", (F.col("share") >= 0.8).alias("recalled"))


@query("v10_linear_kernel", f"WITH {TAGGED} SELECT a.qid, a.tag, b.comment_id, {S.r6(DISTANCE['dot'])} AS distances FROM tagged a JOIN thread_vectors b ON a.tag = b.tag")
def v10(spark, sf):
    return N.nearest(_tagged(spark, sf), V.thread_vectors(spark, sf), None, "dot", group="tag")


@query("j14_candidates_of_tags", f"WITH {TAGGED} SELECT a.qid, a.tag, b.comment_id FROM tagged a JOIN thread_vectors b ON a.tag = b.tag")
def j14(spark, sf):
    asked = V.questions(spark, sf).select("qid", "tag")
    return J.candidates_of_tags(asked, V.thread_vectors(spark, sf)).select("qid", "tag", "comment_id")


@query("w08_own_rank", f"""WITH s AS (SELECT a.tag, a.comment_id AS probe, b.comment_id, {S.r6(COS)} AS score FROM title_vectors a JOIN thread_vectors b ON a.tag = b.tag),
o AS (SELECT tag, probe, score AS own FROM s WHERE probe = comment_id)
SELECT s.tag, s.probe AS comment_id, (1 + sum(CASE WHEN s.comment_id <> s.probe AND (score > own OR (score = own AND s.comment_id < s.probe)) THEN 1 ELSE 0 END))::BIGINT AS rank,
arg_min(s.comment_id, (-score, s.comment_id)) FILTER (WHERE s.comment_id <> s.probe) AS runner_up
FROM s JOIN o ON s.tag = o.tag AND s.probe = o.probe GROUP BY 1, 2""")
def w08(spark, sf):
    return X.own_rank(V.title_vectors(spark, sf), V.thread_index(spark, sf), V.thread_vectors(spark, sf)).drop("scored")


# --- candidate ranking and metrics ----------------------------------------------------------------

CASE_SCORES = f"""ctx AS (SELECT qid, pos, {S.search_text('cand')} AS text FROM case_cands), qtx AS (SELECT qid, {S.search_text('question')} AS text FROM turn_pairs),
{V.sql_mean('cv', 'qid, pos', 'ctx', V.WS, 'idf_words')},
{V.sql_mean('av', 'qid', 'qtx', V.WS, 'idf_words')},
scored AS (SELECT a.qid, b.pos, {S.r6(COS)} AS score FROM av a JOIN cv b ON a.qid = b.qid)"""
FIRST_RANKS = "ranks AS (SELECT t.qid, 1 + sum(CASE WHEN s.score > t.score THEN 1 ELSE 0 END) AS rank FROM scored t JOIN scored s ON t.qid = s.qid WHERE t.pos = 0 GROUP BY t.qid)"


def _scores(spark, sf):
    return Q.candidate_scores(V.cases(spark, sf), _vectoriser(spark, sf), search_text)


def _vectoriser(spark, sf):
    words = E.weighted_words(V.word_vectors(spark, sf), V.idf(spark, sf))
    return lambda df, keys, column: E.mean_vectors(df, keys, column, words, V.DIM)


@query("j15_candidate_scores", f"WITH {CASE_SCORES} SELECT qid, pos, score FROM scored")
def j15(spark, sf):
    return _scores(spark, sf).withColumn("pos", F.col("pos").cast("bigint"))


@query("v09_ranked_candidates", f"WITH {CASE_SCORES} SELECT qid, pos, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS rank FROM scored")
def v09(spark, sf):
    ranked = R.ranked_candidates(_scores(spark, sf))
    return ranked.withColumn("pos", F.col("pos").cast("bigint"))


@query("w02_rank_of_first", f"WITH {CASE_SCORES}, {FIRST_RANKS} SELECT qid, rank::BIGINT AS rank FROM ranks")
def w02(spark, sf):
    return R.rank_of_first(_scores(spark, sf))


DEPTHS = "(SELECT unnest([1, 5, 10, 100, 500, 1000]) AS k)"


@query("a16_hits", f"WITH {CASE_SCORES}, {FIRST_RANKS} SELECT k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0 END), 6) AS hits FROM ranks, {DEPTHS} GROUP BY k")
def a16(spark, sf):
    ranks = R.rank_of_first(_scores(spark, sf))
    return M.ranking_metrics(ranks).select("k", F.round("hits", 6).alias("hits"))


@query("a17_dcg", f"WITH {CASE_SCORES}, {FIRST_RANKS} SELECT k, round(sum(CASE WHEN rank <= k THEN 1 / log2(1 + rank) ELSE 0 END) / count(*), 6) AS dcg FROM ranks, {DEPTHS} GROUP BY k")
def a17(spark, sf):
    ranks = R.rank_of_first(_scores(spark, sf))
    return M.ranking_metrics(ranks).select("k", F.round("dcg", 6).alias("dcg"))


@query("p06_evaluation", f"""WITH {CASE_SCORES}, {FIRST_RANKS} SELECT k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0 END), 6) AS hits,
round(sum(CASE WHEN rank <= k THEN 1 / log2(1 + rank) ELSE 0 END) / count(*), 6) AS dcg FROM ranks, {DEPTHS} GROUP BY k""")
def p06(spark, sf):
    out = Q.evaluate_ranking(V.cases(spark, sf), _vectoriser(spark, sf), clean=search_text)
    return out.select("k", F.round("hits", 6).alias("hits"), F.round("dcg", 6).alias("dcg"))


LONG_LISTS = f"""qtx AS (SELECT qid, {S.search_text('question')} AS text FROM turn_pairs), rtx AS (SELECT qid, {S.search_text('reply')} AS text FROM turn_pairs),
{V.sql_mean('av', 'qid', 'qtx', V.WS, 'idf_words')},
{V.sql_mean('rv', 'qid', 'rtx', V.WS, 'idf_words')},
scored AS (SELECT a.qid, b.qid AS other, {S.r6(COS)} AS score FROM av a, rv b),
ranks AS (SELECT s.qid, 1 + sum(CASE WHEN s.other <> s.qid AND (s.score > o.score OR (s.score = o.score AND s.other < s.qid)) THEN 1 ELSE 0 END) AS rank
  FROM scored s JOIN scored o ON o.qid = s.qid AND o.other = o.qid GROUP BY s.qid)"""


@query("p06_long_lists", f"""WITH {LONG_LISTS} SELECT k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0 END), 6) AS hits,
round(sum(CASE WHEN rank <= k THEN 1 / log2(1 + rank) ELSE 0 END) / count(*), 6) AS dcg FROM ranks, {DEPTHS} GROUP BY k""")
def p06_long(spark, sf):
    """Every reply is a candidate of every question: the rank of the true one, by whole cells of an index."""
    asked = V.turn_pairs(spark, sf).select(F.lit("replies").alias("tag"), F.col("qid").alias("comment_id"), search_text(F.col("question")).alias("text"))
    probes = E.mean_vectors(asked, ["tag", "comment_id"], "text", E.weighted_words(V.word_vectors(spark, sf), V.idf(spark, sf)), V.DIM)
    ranks = X.own_rank(probes, V.reply_index(spark, sf), V.reply_vectors(spark, sf)).select(F.col("comment_id").alias("qid"), "rank")
    return M.ranking_metrics(ranks).select("k", F.round("hits", 6).alias("hits"), F.round("dcg", 6).alias("dcg"))


PROBS = "guess AS (SELECT vec_id, label, list_slice(embedding, 1, 10)::DOUBLE[] AS p FROM embeddings)"


def _guesses(spark, sf):
    """The first ten entries of each vector stand for class probabilities."""
    p = F.slice(F.col("embedding").cast("array<double>"), 1, 10)
    g = V.table(spark, sf, "embeddings").select("vec_id", "label", p.alias("probability"))
    return g.withColumn("prediction", F.array_position("probability", F.array_max("probability")).cast("int") - 1)


ARGMAX = "list_position(p, list_max(p)) - 1"


@query("a13_confusion_counts", f"WITH {PROBS} SELECT label, {ARGMAX} AS prediction, count(*) AS rows FROM guess GROUP BY 1, 2")
def a13(spark, sf):
    return M.confusion_counts(_guesses(spark, sf))


@query("a13_confusion_matrix", f"WITH {PROBS} SELECT label, " + ", ".join(
    f'sum(CASE WHEN {ARGMAX} = {i} THEN 1 ELSE 0 END)::BIGINT AS "{i}"' for i in range(10)) + " FROM guess GROUP BY label")
def a13m(spark, sf):
    return M.confusion_matrix(_guesses(spark, sf), list(range(10)))


@query("a14_accuracy", f"WITH {PROBS} SELECT round(avg(CASE WHEN {ARGMAX} = label THEN 1.0 ELSE 0 END), 6) AS accuracy FROM guess")
def a14(spark, sf):
    return M.accuracy(_guesses(spark, sf)).select(F.round("accuracy", 6).alias("accuracy"))


@query("a15_top_k_accuracy", f"""WITH {PROBS}, flat AS (SELECT vec_id, label, p[label + 1] AS own, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS i FROM guess),
r AS (SELECT vec_id, 1 + sum(CASE WHEN x > own OR (x = own AND i > label) THEN 1 ELSE 0 END) AS rank FROM flat GROUP BY vec_id)
SELECT k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0 END), 6) AS accuracy FROM r, (SELECT unnest([1, 3, 4, 5, 10]) AS k) GROUP BY k""")
def a15(spark, sf):
    return M.top_k_accuracy(_guesses(spark, sf)).select("k", F.round("accuracy", 6).alias("accuracy"))


@query("w04_confident_tags", """WITH p AS (SELECT vec_id, list_transform(range(1, 5), lambda i: abs(embedding[i]::DOUBLE)) AS w FROM embeddings),
f AS (SELECT vec_id, unnest(w) / list_sum(w) AS score, generate_subscripts(w, 1) AS i FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, i DESC) AS rank, max(score) OVER (PARTITION BY vec_id) AS best FROM f)
SELECT vec_id, rank, ['en','fr','de','es'][i] AS tag, round(score, 6) AS score FROM r WHERE rank <= 3 AND (best <= 0.6 OR rank = 1)""")
def w04(spark, sf):
    sizes = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 4), lambda x: F.abs(x))
    total = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + x)
    names = F.array(*[F.lit(x) for x in V.LANGS])
    odds = F.transform(sizes, lambda x, i: F.struct((x / total).alias("score"), i.alias("index"), F.element_at(names, i + 1).alias("tag")))
    chosen = V.table(spark, sf, "embeddings").select("vec_id", F.posexplode(R.confident_tags(odds, 3, 0.6)).alias("pos", "t"))
    return chosen.select("vec_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "t.tag", F.round("t.score", 6).alias("score"))


# --- term weights ---------------------------------------------------------------------------------

@query("a08_term_idf", "SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM idf")
def a08(spark, sf):
    return V.idf.build(spark, sf).select("term", "df", F.round("idf", 6).alias("idf"))


WEIGHTS = f"""{DOC_TEXTS}, dtf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({V.WS}) AS term FROM dtx) GROUP BY ALL),
dw AS (SELECT doc_id, term, tf * idf AS w FROM dtf JOIN idf USING (term)),
dn AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM dw)"""


def _doc_weights(spark, sf):
    docs = V.texts(spark, sf).select("doc_id", search_text(F.col("text")).alias("text"))
    return I.term_weights(docs, ["doc_id"], "text", V.idf(spark, sf))


@query("m01_term_weights", f"WITH {WEIGHTS} SELECT doc_id, term, round(weight, 6) AS weight FROM dn")
def m01(spark, sf):
    return _doc_weights(spark, sf).select("doc_id", "term", F.round("weight", 6).alias("weight"))


SIMILAR = f"""{WEIGHTS}, qtf AS (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest({V.WS}) AS term FROM question_texts) GROUP BY ALL),
qw2 AS (SELECT qid, term, tf * idf AS w FROM qtf JOIN idf USING (term)),
qn AS (SELECT qid, term, w / sqrt(sum(w * w) OVER (PARTITION BY qid)) AS weight FROM qw2),
sims AS (SELECT qid, doc_id, round(sum(qn.weight * dn.weight), 6) AS score FROM qn JOIN dn USING (term) GROUP BY qid, doc_id)"""


@query("v15_term_similarity", f"WITH {SIMILAR} SELECT qid, doc_id, score FROM sims")
def v15(spark, sf):
    asked = I.term_weights(_question_texts(spark, sf), ["qid"], "text", V.idf(spark, sf))
    scored = I.term_similarity(asked, _doc_weights(spark, sf), item="doc_id")
    return scored.withColumn("score", F.round("score", 6))


@query("w05_most_similar", f"WITH {SIMILAR} SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sims) WHERE rank <= 5")
def w05(spark, sf):
    asked = written(I.term_weights(_question_texts(spark, sf), ["qid"], "text", V.idf(spark, sf)), "asked")
    return I.most_similar(asked, V.doc_weights(spark, sf), 5, item="doc_id")


J13 = f"""WITH cnt AS (SELECT term AS token, count(*) AS count FROM (SELECT unnest(tokens) AS term FROM doc_tokens) GROUP BY 1),
voc AS (SELECT token FROM cnt WHERE count > 2 ORDER BY count DESC, token LIMIT 1000),
mean AS (SELECT list(m ORDER BY pos) AS vec FROM (SELECT avg(v) AS m, pos FROM (SELECT unnest(vec) AS v, generate_subscripts(vec, 1) AS pos FROM word_vectors) GROUP BY pos)),
al AS (SELECT token, coalesce(w.vec, mean.vec) AS vec FROM voc LEFT JOIN word_vectors w ON voc.token = w.word, mean) {entries_sql('al', 'token')}"""


def _aligned(spark, sf, most):
    tokens = V.texts(spark, sf).select(F.explode(search_tokens(F.col("text"))).alias("token"))
    vocabulary = token_vocabulary(tokens, max_vocab=most, min_freq=2)
    return entries(E.aligned_vectors(vocabulary, V.word_vectors(spark, sf), V.DIM), "token")


@query("j13_aligned_vectors", J13)
def j13(spark, sf):
    return _aligned(spark, sf, 1000)


@query("j13_full_vocabulary", J13.replace("LIMIT 1000", "LIMIT 60000"))
def j13_full(spark, sf):
    return _aligned(spark, sf, 60_000)


# --- features and answers -------------------------------------------------------------------------

def features_sql(text: str, asked_texts: str = "question_texts") -> str:
    """CTEs ending in f_<text>(qid, comment_id, tfidf, ngram, combo), from cand and the questions.

    Centred products are written out as q.x - m.x - q.m + m.m.
    """
    p = f"{text}_"
    words = S.space_tokens(f"lower({text})")

    def centred(out, rows, asked, value, where=""):
        return f"""{out}_m AS (SELECT qid, term, sum({value}) / any_value(n) AS m FROM {rows} JOIN {p}n USING (qid) {where} GROUP BY qid, term),
{out}_q AS (SELECT qid, sum(m * m) AS mm, sum(m * coalesce(q, 0)) AS qm FROM {out}_m LEFT JOIN {asked} USING (qid, term) GROUP BY qid),
{out} AS (SELECT r.qid, r.comment_id, sum({value} * coalesce(q, 0)) AS qx, sum({value} * m) AS mx FROM {rows} r JOIN {out}_m m USING (qid, term) LEFT JOIN {asked} a USING (qid, term) GROUP BY 1, 2)"""

    return f"""{p}n AS (SELECT qid, count(*)::DOUBLE AS n FROM cand GROUP BY qid),
{p}t AS (SELECT qid, comment_id, term, count(*)::DOUBLE AS c FROM (SELECT qid, comment_id, unnest({words}) AS term FROM cand) GROUP BY ALL),
{p}v AS (SELECT qid, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT qid, term, count(*)::DOUBLE AS df FROM {p}t GROUP BY ALL) JOIN {p}n USING (qid) WHERE df <= 0.9 * n),
{p}x AS (SELECT qid, comment_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY qid, comment_id)) AS x FROM (SELECT qid, comment_id, term, c * idf AS w FROM {p}t JOIN {p}v USING (qid, term))),
{p}qt AS (SELECT qid, term, count(*)::DOUBLE AS c FROM (SELECT qid, unnest({V.WS}) AS term FROM {asked_texts}) GROUP BY ALL),
{p}qx AS (SELECT qid, term, w / sqrt(sum(w * w) OVER (PARTITION BY qid)) AS q FROM (SELECT qid, term, c * idf AS w FROM {p}qt JOIN {p}v USING (qid, term))),
{S.grams_cte(p + 'g', 'qid, comment_id', 'cand', text)},
{p}gt AS (SELECT qid, comment_id, gram AS term, count(*)::DOUBLE AS c FROM {p}g GROUP BY ALL),
{S.grams_cte(p + 'h', 'qid', asked_texts, 'text')},
{p}ht AS (SELECT qid, gram AS term, count(*)::DOUBLE AS q FROM {p}h GROUP BY ALL),
{p}rt AS (SELECT qid, comment_id, term, c FROM {p}gt JOIN (SELECT qid, term FROM {p}gt JOIN {p}n USING (qid) GROUP BY qid, term HAVING count(*) <= 0.9 * any_value(n)) USING (qid, term)),
{centred(p + 'cw', p + 'x', p + 'qx', 'x')},
{centred(p + 'cg', p + 'gt', p + 'ht', 'c')},
{centred(p + 'cr', p + 'rt', p + 'ht', 'c')},
f_{text} AS (SELECT b.qid, b.comment_id, coalesce(w.qx, 0) AS tfidf,
  coalesce(g.qx - g.mx, 0) - coalesce(gq.qm - gq.mm, 0) AS ngram,
  coalesce(w.qx - w.mx, 0) - coalesce(wq.qm - wq.mm, 0) + coalesce(r.qx - r.mx, 0) - coalesce(rq.qm - rq.mm, 0) AS combo
  FROM cand b LEFT JOIN {p}cw w USING (qid, comment_id) LEFT JOIN {p}cg g USING (qid, comment_id) LEFT JOIN {p}cr r USING (qid, comment_id)
  LEFT JOIN {p}cw_q wq USING (qid) LEFT JOIN {p}cg_q gq USING (qid) LEFT JOIN {p}cr_q rq USING (qid))"""


NEAR = f"""{TAGGED}, near AS ({nearest_sql('angular', 'tagged', 'thread_vectors', 'qid', 5)}),
cand AS (SELECT n.qid, n.comment_id, n.distances, p.title, p.comment AS comment_parent, p.score AS score_parent, p.tags FROM near n JOIN posts p ON n.comment_id = p.comment_id
  WHERE n.comment_id IN (SELECT parent_id FROM posts WHERE comment IS NOT NULL))"""
LISTS = """lists AS (SELECT parent_id, string_agg(comment || '::' || score::VARCHAR, chr(10) || '--' ORDER BY score DESC, comment_id) AS combined FROM posts WHERE parent_id IS NOT NULL GROUP BY parent_id)"""


def _topic(spark, sf, k=5):
    return Q.answer_topic_questions(
        V.questions(spark, sf), V.posts(spark, sf), None, V.word_vectors(spark, sf), V.idf(spark, sf), V.DIM, k,
        search=Q.index_search(V.thread_index(spark, sf)))


@query("p09_topic_answers", f"WITH {NEAR}, {LISTS} SELECT qid, comment_id, title, comment_parent, distances, tags, combined FROM cand JOIN lists ON parent_id = comment_id")
def p09(spark, sf):
    found = _topic(spark, sf).withColumn("combined", F.array_join("combined_comments", "\n--"))
    return found.select("qid", "comment_id", "title", "comment_parent", "distances", "tags", "combined")


@query("f15_result_page", f"WITH {NEAR}, {LISTS} SELECT qid, title, comment_parent, round(distances, 2) AS distances, tags, combined AS combined_comments FROM cand JOIN lists ON parent_id = comment_id")
def f15(spark, sf):
    from threadloom.operators.selection import result_page

    shown = R.by_distance(_topic(spark, sf), "qid")
    return result_page(shown, "qid").withColumn("combined_comments", F.array_join("combined_comments", "\n--"))


def _candidates(spark, sf):
    return written(_topic(spark, sf).select("qid", "comment_id", "title", "comment_parent"), "candidates")


def _cleaned_questions(spark, sf):
    return V.questions(spark, sf).select("qid", search_text(F.col("question")).alias("question"))


def _feature_query(name, text, kind):
    value = {"tfidf": "tfidf", "ngram": "ngram", "combo": "combo"}[kind]

    @query(name, f"WITH {NEAR}, {features_sql(text)} SELECT qid, comment_id, {S.r6(value, 5)} AS value FROM f_{text}")
    def run(spark, sf):
        found = _candidates(spark, sf)
        features = W.text_features(found.select("qid", "comment_id", text), _cleaned_questions(spark, sf), text)
        return features.select("qid", "comment_id", F.round(f"{kind}_{text}", 5).alias("value"))


_feature_query("v11_fitted_tfidf", "comment_parent", "tfidf")
_feature_query("v12_char_ngrams", "comment_parent", "ngram")
_feature_query("v13_combined_features", "comment_parent", "combo")
_feature_query("v11_fitted_tfidf_title", "title", "tfidf")
_feature_query("v12_char_ngrams_title", "title", "ngram")
_feature_query("v13_combined_features_title", "title", "combo")

PREDICTED = """tagged AS (SELECT v.qid, q.tag, v.vec FROM question_vectors v JOIN (SELECT qid, tag1 AS tag FROM predicted UNION ALL SELECT qid, tag2 FROM predicted) q ON v.qid = q.qid)"""
SCALED_COLUMNS = ["d", "t1", "n1", "c1", "t2", "n2", "c2"]
SCALE = ", ".join(
    f"CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 0 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END AS {c}" for c in SCALED_COLUMNS)
WEIGHED = f"""{PREDICTED}, near AS ({nearest_sql('angular', 'tagged', 'thread_vectors', 'qid', 10)}),
cand AS (SELECT n.qid, n.comment_id, min(n.distances) AS distances, any_value(p.title) AS title, any_value(p.comment) AS comment_parent, any_value(p.tags) AS tags
  FROM near n JOIN posts p ON n.comment_id = p.comment_id WHERE n.comment_id IN (SELECT parent_id FROM posts WHERE comment IS NOT NULL) GROUP BY 1, 2),
{features_sql('title')}, {features_sql('comment_parent')},
raw AS (SELECT c.qid, c.comment_id, c.distances, c.tags, c.distances AS d, a.tfidf AS t1, a.ngram AS n1, a.combo AS c1, b.tfidf AS t2, b.ngram AS n2, b.combo AS c2
  FROM cand c JOIN f_title a USING (qid, comment_id) JOIN f_comment_parent b USING (qid, comment_id)),
scaled AS (SELECT qid, comment_id, distances, tags, {SCALE} FROM raw WINDOW w AS (PARTITION BY qid)),
weighed AS (SELECT s.qid, s.comment_id, s.distances, (1 - d) * 0.92 + t1 * 0.74 + n1 * 0.21 + c1 * 0.33 + t2 * 0.74 + n2 * 0.21 + c2 * 0.33
  + CASE WHEN contains(replace(tags, '-', '_'), tag1) THEN score1 WHEN contains(replace(tags, '-', '_'), tag2) THEN score2 ELSE 0 END AS weight
  FROM scaled s JOIN predicted p ON s.qid = p.qid)"""


@query("p05_answers", f"""WITH {WEIGHED}, {LISTS} SELECT qid, comment_id, distances, round(weight, 6) AS final_weight, combined,
  row_number() OVER (PARTITION BY qid ORDER BY round(weight, 6) DESC, comment_id)::INTEGER AS rank FROM weighed JOIN lists ON parent_id = comment_id""")
def p05(spark, sf):
    found = Q.answer_questions(
        V.predicted(spark, sf), V.posts(spark, sf), None, V.word_vectors(spark, sf), V.idf(spark, sf), V.DIM,
        search=Q.index_search(V.thread_index(spark, sf)))
    return found.select(
        "qid", "comment_id", "distances", "final_weight", "rank",
        F.array_join("combined_comments", "\n--").alias("combined"))


GRID = [C.RERANK_WEIGHTS, {"distance": 1.0, "tfidf": 0.0, "ngram": 0.0, "combo": 0.0}, {"distance": 0.0, "tfidf": 1.0, "ngram": 0.0, "combo": 0.0},
        {"distance": 0.5, "tfidf": 0.5, "ngram": 0.5, "combo": 0.5}]
GRID_SQL = ", ".join(f"({i}, {g['distance']}::DOUBLE, {g['tfidf']}::DOUBLE, {g['ngram']}::DOUBLE, {g['combo']}::DOUBLE)" for i, g in enumerate(GRID))


@query("v16_weight_search", f"""WITH cand AS (SELECT qid, pos AS comment_id, cand AS title, cand AS comment_parent FROM case_cands),
case_questions AS (SELECT qid, {S.search_text('question')} AS text FROM turn_pairs),
{features_sql('title', 'case_questions')}, g(setting, wd, wt, wn, wc) AS (VALUES {GRID_SQL}),
raw AS (SELECT qid, comment_id, 0.0 AS d, tfidf AS t1, ngram AS n1, combo AS c1, tfidf AS t2, ngram AS n2, combo AS c2 FROM f_title),
scaled AS (SELECT qid, comment_id, {SCALE} FROM raw WINDOW w AS (PARTITION BY qid)),
s AS (SELECT setting, qid, comment_id AS pos, round((1 - d) * wd + 2 * (t1 * wt + n1 * wn + c1 * wc), 6) AS score FROM scaled, g),
r AS (SELECT t.setting, t.qid, 1 + sum(CASE WHEN s.score > t.score THEN 1 ELSE 0 END) AS rank FROM s t JOIN s ON s.setting = t.setting AND s.qid = t.qid WHERE t.pos = 0 GROUP BY 1, 2)
SELECT *, row_number() OVER (ORDER BY dcg DESC, setting) = 1 AS best FROM
  (SELECT setting, round(sum(CASE WHEN rank <= 10 THEN 1 / log2(1 + rank) ELSE 0 END) / count(*), 6) AS dcg FROM r GROUP BY setting)""")
def v16(spark, sf):
    cases = V.cases(spark, sf)
    found = cases.select("qid", F.posexplode("cands").alias("pos", "title")).select(
        "qid", F.col("pos").cast("bigint").alias("comment_id"), "title", F.col("title").alias("comment_parent"))
    found = written(found, "candidates")
    asked = cases.select("qid", search_text(F.col("question")).alias("question"))
    features = W.text_features(found.select("qid", "comment_id", "title"), asked, "title")
    twice = features.select("*", *[F.col(f"{k}_title").alias(f"{k}_comment_parent") for k in ("tfidf", "ngram", "combo")])
    flat = twice.select("*", F.lit(0.0).alias("scaled_distance"), F.lit(0.0).alias("tag_score"), F.col("comment_id").alias("pos"))
    scaled = min_max_scaled(flat, W.FEATURES, "qid")
    return W.best_weights(scaled, GRID, 10)


@query("v16_line_search", """SELECT setting::INTEGER AS setting, count(*) AS cases, TRUE AS reached, TRUE AS rising, TRUE AS agrees
FROM turn_pairs, range(4) g(setting) GROUP BY 1""")
def v16_lines(spark, sf):
    """Seven free weights, searched line by line; every fixed setting has to be reached.

    Distance is that of the text vectors, titles are the raw replies, bodies their search form. ``agrees``:
    ranks counted by the plain metric give the DCG that the search reports.
    """
    cases = V.cases(spark, sf)
    asked = cases.select("qid", search_text(F.col("question")).alias("question"))
    spread = cases.select("qid", F.posexplode("cands").alias("pos", "title")).select(
        "qid", F.col("pos").cast("bigint").alias("comment_id"), "title", search_text(F.col("title")).alias("comment_parent"))
    vectorise = partial(E.idf_vectors, words=V.word_vectors(spark, sf), idf=V.idf(spark, sf), dim=V.DIM)
    near = Q.candidate_scores(cases, vectorise, search_text).select(
        "qid", F.col("pos").cast("bigint").alias("comment_id"), (1 - F.coalesce("score", F.lit(0.0))).alias("scaled_distance"))
    featured = W.all_features(written(spread.join(near, ["qid", "comment_id"]), "candidates"), asked)
    named = featured.select("*", F.lit(0.0).alias("tag_score"), F.col("comment_id").alias("pos"))
    scored = written(min_max_scaled(named, ["scaled_distance", *W.FEATURES], "qid"), "scored")
    found = L.searched_weights(scored, 10, [L.free_weights(g) for g in GRID])
    total = (1 - F.col("scaled_distance")) * found.weights["distance"] + F.col("tag_score")
    for feature in W.FEATURES:
        total = total + F.col(feature) * found.weights[feature]
    ranks = R.rank_of_first(scored.select("qid", "pos", F.round(total, 9).alias("score")))
    counted = M.ranking_metrics(ranks, [10]).first()["dcg"]
    rising = all(a < b for a, b in zip(found.path, found.path[1:]))
    settings = W.best_weights(scored, GRID, 10).select("setting", "dcg")
    return settings.select(
        F.col("setting").cast("int").alias("setting"), F.lit(cases.count()).cast("bigint").alias("cases"),
        (F.lit(found.dcg) >= F.col("dcg") - 1e-6).alias("reached"), F.lit(rising).alias("rising"),
        F.lit(abs(counted - found.dcg) < 1e-9).alias("agrees"))
