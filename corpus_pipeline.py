"""The corpus pipeline: language, repeated lines, near-duplicates, benchmark
leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents. The first four keep the
columns of documents; the last returns the packed pieces. SQL can't state the
tokenizer and the language model, so there is no oracle SQL; the stages are
tested against brute force in tests/llm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.llm import decontaminate, lang_backoff, line_dedup, near_dup, packing
from flowsift.llm.base import fresh, quoted, table
from flowsift.llm.queries import tokenizer_file
from flowsift.session import scratch_path

# posterior of the best language below which a text is taken to be of none
LEAST_SCORE = 0.5

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: neither undetermined nor below LEAST_SCORE."""
    model = lang_backoff.fit_languages(docs)
    p, = fresh(docs, "_language")
    seen = lang_backoff.with_languages(docs, model, p)
    sure = (F.col(p)["lang_pred"] != lang_backoff.UNDETERMINED) & (F.col(p)["score"] >= LEAST_SCORE)
    return seen.filter(sure).drop(p)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated line windows; a document that loses all its text goes."""
    out = line_dedup.dedup_lines(docs)
    removed = quoted(out.columns[-1])  # n_removed, under its own name
    out = out.filter((removed == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        count = F.when(removed > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", count)
    return out.select(*map(quoted, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8)."""
    return near_dup.drop_near_duplicates(docs, words_per_shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_file(), capacity=2048)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, own = table(spark, sf_dir, "documents"), uuid.uuid4().hex
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline/{own}/{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
