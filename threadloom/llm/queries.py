"""The registered query of each operator, over its whole table, and its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import bpe, langid, licenses, mtree, packing, pii, quality, repair, reshard, rules, simhash, substring, trie
from threadloom.llm.common import remainder
from threadloom.llm.ordered import digests
from threadloom.session import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    profiles = langid.fit_profiles(docs, learn=remainder("doc_id", 4) != 2)
    found = langid.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer, capacity=2048)


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = pii.found(docs, pii.fit(docs))
    counts = [pii.count_of("base", kind).alias(f"n_{kind}") for kind in pii.BASE]
    every = F.size("spans").cast("bigint")
    return spans.select(
        "doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"),
        every.alias("n_spans"), (every - F.size("base")).alias("n_further"),
    )


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(substring.pieces(table(spark, sf_dir, "documents")), min_words=50)


@query
def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    found = bpe.encoded(table(spark, sf_dir, "documents"), ranks, pattern)
    return found.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = licenses.build_index()
    found = written(licenses.hits(table(spark, sf_dir, "documents"), index), "hits")
    marked = licenses.labelled(found, index, licenses.word_idf(found, index))
    return marked.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learn=remainder("doc_id", 5) != 0)
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    predicted = (F.col("score") >= 0.3).cast("int")
    return quality.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    counts = written(rules.counted(docs).drop("text"), "counts")
    cutoffs = written(rules.thresholds(counts, table(spark, sf_dir, "labels"), "lang"), "cutoffs")
    judged = rules.verdicts(counts, cutoffs, "lang").withColumn("base_failed", rules.base_failed())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mtree.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


@query
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve shards by checksum of the text, so copies lie together, become sixteen of equal bytes."""
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("bigint") + 1
    docs = table(spark, sf_dir, "documents").select("doc_id", size.alias("bytes"), F.crc32(text).alias("text_crc32"))
    old = (F.col("text_crc32") % 12).cast("int")
    found = reshard.resharded(docs, old, F.col("bytes"), weights=[1] * 16)
    nothing = F.lit(None).cast("int")
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", nothing.alias("grown_shard"))


@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(trie.ordered_turns(table(spark, sf_dir, "conversations")), "ordered")
    shared, base = F.crc32(F.col("conv_id").cast("string")) % 6, F.col("conv_id") - F.col("conv_id") % 100
    return trie.rolled_up(*trie.rebuilt(turns, shared, base, most=5))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = repair.ordered_rows(repair.damaged(conversations))
    found = written(repair.solved(written(repair.blocks_of(rows), "blocks")), "solved")
    line = F.concat("role", F.lit(":"), "text").alias("line")
    hashes = digests(repair.repaired(rows, found).select("conv", "at", "sub", line), ["conv"], ["at", "sub"], "line", "\n", "repaired_sha256")
    gaps = rows.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    ids = conversations.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    whole = ids.join(gaps, "conv", "left").join(repair.summaries(found), "conv", "left").join(hashes, "conv", "left")
    counts = [F.coalesce(F.col(n).cast("bigint"), F.lit(0).cast("bigint")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.coalesce("repaired_sha256", F.lit(trie.EMPTY_SHA256)).alias("repaired_sha256")
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), digest)


ORACLES["op3_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
)
SELECT q.vec_id AS query_id,
  CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, v.e) DESC, v.vec_id) AS INT) AS rank,
  v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10
"""


def _rules_sql() -> str:
    """The rules in SQL: measures, all tests of all cutoffs, and the verdicts."""
    risk = rules.Risk()
    measures = ", ".join(
        f"('{name}', coalesce({formula.replace('/ n_words', '/ nullif(n_words, 0)').replace('/ n_lines', '/ nullif(n_lines, 0)')}, 0.0))"
        for name, (formula, _) in rules.RULES.items()
    )
    cuts = ", ".join(f"('{name}', CAST({cut} AS DOUBLE))" for name, (_, values) in rules.RULES.items() for cut in values)
    return rf"""
WITH split AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
    [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM split)
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM (
    SELECT doc_id, i, unnest(range(5)) AS j FROM (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1)
  ) GROUP BY doc_id
), counts AS (
  SELECT split.doc_id, lang, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, len(l) AS n_lines, len(list_distinct(w)) AS n_distinct,
    CAST(len(regexp_extract_all(t, '!')) AS BIGINT) AS n_shouts
  FROM split LEFT JOIN covered ON covered.doc_id = split.doc_id
), based AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts
), long AS (
  SELECT doc_id, lang, base_failed, m.rule, CAST(m.value AS DOUBLE) AS value FROM based, LATERAL (VALUES {measures}) AS m(rule, value)
), cuts AS (SELECT * FROM (VALUES {cuts}) AS c(rule, cut)
), over AS (
  SELECT doc_id, long.rule, any_value(lang) AS lang, any_value(base_failed) AS base_failed, CAST(sum(CASE WHEN value > cut THEN 1 ELSE 0 END) AS BIGINT) AS over
  FROM long JOIN cuts ON cuts.rule = long.rule GROUP BY doc_id, long.rule
), judged AS (
  SELECT over.*, quality, ('0x' || substr(md5(CAST(over.doc_id AS VARCHAR)), 1, 8))::BIGINT % {rules.PROPOSING} = 0 AS proposes
  FROM over JOIN labels ON labels.doc_id = over.doc_id WHERE quality IN (0, 1) AND NOT base_failed
), strata AS (
  SELECT lang, sum(CASE WHEN proposes THEN 0 ELSE quality END) AS good, count(*) OVER () + 1 AS strata FROM judged WHERE rule = 'symbols' GROUP BY lang
), groups AS (
  SELECT lang, strata, CASE WHEN good >= ceil((ln({risk.error}) - ln(strata)) / ln(1 - {risk.rate})) THEN {{'s': lang}} END AS g FROM strata
), rows AS (
  SELECT judged.*, g, strata FROM judged JOIN groups ON groups.lang IS NOT DISTINCT FROM judged.lang
), tried AS (
  SELECT g, rule, level, sum(quality) AS good, sum(CASE WHEN over >= {rules.CUTOFFS} + 1 - level THEN quality ELSE 0 END) AS wrong,
    sum(CASE WHEN over >= {rules.CUTOFFS} + 1 - level THEN 1 - quality ELSE 0 END) AS right_
  FROM rows, (SELECT unnest(range(1, {rules.CUTOFFS} + 1)) AS level) WHERE proposes GROUP BY ALL
), proposed AS (
  SELECT g, rule, level FROM tried WHERE right_ > 0 AND wrong <= good * ({risk.rate} / {len(rules.RULES)})
  QUALIFY row_number() OVER (PARTITION BY g, rule ORDER BY right_ DESC, level) = 1
), steps AS (
  SELECT rows.doc_id, rows.g, strata, any_value(quality) AS quality, coalesce(max(level + over - {rules.CUTOFFS} - 1), -1) AS most
  FROM rows LEFT JOIN proposed ON proposed.g IS NOT DISTINCT FROM rows.g AND proposed.rule = rows.rule WHERE NOT proposes GROUP BY rows.doc_id, rows.g, strata
), tested AS (
  SELECT g, strata, back, sum(quality) AS good, sum(CASE WHEN most >= back THEN quality ELSE 0 END) AS wrong, sum(CASE WHEN most >= back THEN 1 - quality ELSE 0 END) AS right_
  FROM steps, (SELECT unnest(range({rules.CUTOFFS})) AS back) GROUP BY ALL
), ended AS (
  SELECT *, coalesce(max(CASE WHEN NOT holds THEN back END) OVER (PARTITION BY g), -1) AS ends FROM (
    SELECT *, wrong < good * {risk.rate} AND (
      SELECT sum(exp(lgamma(good + 1) - (CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END) - lgamma(good - j + 1)
        + j * ln({risk.rate}) + (good - j) * ln(1 - {risk.rate})))
      FROM (SELECT unnest(range(CAST(wrong AS BIGINT) + 1)) AS j)) <= {risk.error} / strata AS holds FROM tested)
), best AS (
  SELECT g, back FROM ended WHERE back > ends AND right_ > 0 QUALIFY row_number() OVER (PARTITION BY g ORDER BY right_ DESC, back DESC) = 1
), rejected AS (
  SELECT DISTINCT over.doc_id FROM over JOIN groups ON groups.lang IS NOT DISTINCT FROM over.lang JOIN best ON best.g IS NOT DISTINCT FROM groups.g
    JOIN proposed ON proposed.g IS NOT DISTINCT FROM groups.g AND proposed.rule = over.rule WHERE over.over >= {rules.CUTOFFS} + 1 - (level - back)
)
SELECT based.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rejected.doc_id IS NULL AS kept
FROM based LEFT JOIN rejected ON rejected.doc_id = based.doc_id
"""


ORACLES["op4_quality_rules"] = _rules_sql()
