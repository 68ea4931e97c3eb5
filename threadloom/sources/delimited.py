"""CSV and TSV files in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import prepared_text
from threadloom.sources.quoted import quoted_records

QUESTIONS = "Id bigint, OwnerUserId bigint, CreationDate string, Score bigint, Title string, Body string"
ANSWERS = "Id bigint, OwnerUserId bigint, CreationDate string, ParentId bigint, Score bigint, Body string"
TAGS = "Id bigint, Tag string"


_DIALECT = {"quote": '"', "escape": '"', "multiLine": "true"}


def csv_dump(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Latin-1 CSV with a header; doubled quotes and line breaks inside quotes are text.

    A large file is read by many tasks, see ``sources.quoted``; a quote inside an unquoted field is not
    text here (:func:`csv_dump_by_file` takes it as such).
    """
    records = quoted_records(spark, path, "ISO-8859-1").where(~F.col("header"))
    return records.select(F.from_csv("value", F.lit(schema), _DIALECT).alias("r")).select("r.*")


def csv_dump_by_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As :func:`csv_dump`, one task per file."""
    return spark.read.csv(path, schema=schema, header=True, encoding="ISO-8859-1", **_DIALECT)


def write_csv(df: DataFrame, path: str, header: bool = True, encoding: str = "UTF-8") -> None:
    """CSV in the same dialect as :func:`csv_dump`."""
    df.write.csv(path, header=header, encoding=encoding, quote='"', escape='"', quoteAll=True)


def word_vector_file(spark: SparkSession, path: str) -> DataFrame:
    """``word \\t f1 … fdim`` lines as (word, vec)."""
    parts = F.split("value", "\t")
    values = F.slice(parts, F.lit(2), F.size(parts) - 1)
    numbers = F.transform(values, lambda x: x.cast("float").cast("double"))
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("word"), numbers.alias("vec"))


def vector_dim(words: DataFrame) -> int:
    """The one vector length of a word table; different lengths are an error."""
    low, high = words.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if low != high:
        raise ValueError(f"word vectors of {low} to {high} dimensions")
    return low


def write_word_vectors(words: DataFrame, path: str) -> None:
    numbers = F.array_join(F.transform("vec", lambda x: x.cast("float").cast("string")), "\t")
    words.select(F.concat_ws("\t", "word", numbers)).write.text(path)


def tsv_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated lines as an array of fields; blanks at the line ends do not count."""
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    return spark.read.text(path).select(F.split(line, "\t").alias("fields"))


def ranking_cases(corpus: DataFrame) -> DataFrame:
    """(question, cands): first field and the rest, the true duplicate first."""
    fields = F.col("fields")
    return corpus.select(fields[0].alias("question"), F.slice(fields, F.lit(2), F.size(fields) - 1).alias("cands"))


def prepared_corpus(corpus: DataFrame) -> DataFrame:
    """Each field of each line in its prepared form, joined by tabs again."""
    cleaned = F.transform("fields", prepared_text)
    return corpus.select(F.array_join(cleaned, "\t").alias("value"))


def prepare_file(spark: SparkSession, source: str, target: str) -> None:
    """Clean a whole TSV corpus into another."""
    prepared_corpus(tsv_corpus(spark, source)).write.text(target)
