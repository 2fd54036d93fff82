"""The registered queries of the training-data operators: one per operator,
over its whole table, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.llm import (chat_format, decontaminate, hard_negatives, lang_backoff, line_dedup, mtree_search,
                          near_dup, oracles, packing, period_runs, pii_bootstrap, quality_nbsvm, shard_tree,
                          token_store)
from flowsift.llm.base import ORACLES, QUERIES, fold_of, query, table
from flowsift.session import scratch_path

__all__ = ["ORACLES", "QUERIES"]


def tokenizer_file() -> str:
    """The vocabulary file of the packing query; set FLOWSIFT_TOKENIZER to use another."""
    import os
    given = os.environ.get("FLOWSIFT_TOKENIZER")
    if given:
        return given
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_shard_tree", oracles.SHARD_TREE)
def op1_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tree.assign_shards(table(spark, sf_dir, "documents"), n_shards=8)


@query("op2_chat_format", oracles.CHAT)
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = F.lit("<|im_end|><|im_start|>assistant ok")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  says.alias("text"))
    return chat_format.chat_digest(rows.unionByName(probe))


@query("op3_minhash_bayes", oracles.NEAR_DUP)
def op3_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=4, percent=80)


@query("op4_quality_nbsvm")
def op4_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold_of(F.col("doc_id")) == 0
    model = quality_nbsvm.fit_quality(docs.filter(~held), table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", held.alias("held_out"), quality_nbsvm.quality_score(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(), capacity=2048)


@query("op6_bm25_decontamination", oracles.DECONTAMINATION)
def op6_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated_pairs(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in (
        "overlap", "question_overlap", "answer_overlap")])


@query("op7_contextual_pii")
def op7_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.personal_data_digest(table(spark, sf_dir, "documents"))


@query("op8_mtree_topk", oracles.TOP_K)
def op8_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree_search.top_k(table(spark, sf_dir, "embeddings"), lambda v: v % 20 == 0, k=20)


@query("op9_language_backoff")
def op9_language_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold_of(F.col("doc_id")) == 0
    model = lang_backoff.fit_languages(docs.filter(~held))
    found = lang_backoff.with_languages(docs.withColumn("held_out", held), model, "p")
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


@query("op10_line_dedup", oracles.LINES)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op11_token_store")
def op11_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"token_store/{uuid.uuid4().hex}")
    token_store.write_shards(table(spark, sf_dir, "documents"), path, tokenizer_file())
    return token_store.read_documents(spark, path)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: documents whose id's crc32 h is divisible by 10 repeat, from word a
    = g % n on (g = h div 10), the first p = 1 + (n - a) div (3 + g % 8) words."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    n = F.size("w")
    body = (docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(h % 10 == 0, words))
            .withColumn("g", F.expr("h div 10")).withColumn("n", n)
            .withColumn("a", (F.col("g") % F.greatest("n", F.lit(1))).cast("int"))
            .withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))")))
    times = F.expr("int((n - a + p - 1) div p)")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times)), F.lit(1), F.col("n") - F.col("a"))
    made = F.concat_ws(" ", F.slice("w", F.lit(1), F.col("a")), tail)
    return body.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), made).otherwise(F.col("text")).alias("text"))


@query("op12_period_runs", oracles.RUNS)
def op12_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_runs.run_digest(with_planted_runs(table(spark, sf_dir, "documents")))


@query("op13_hard_negatives", oracles.HARD_NEGATIVES)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), lambda v: v % 50 == 0)
