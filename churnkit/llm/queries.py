"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, fim, fingerprints, hard_negatives, lm, pii, secret_scan, simhash, substring_dedup, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_chat(turns.unionByName(chat.probe_conversation(spark))))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, distance=3))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(_table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, _table(spark, sf_dir, "labels"), toxicity.CATEGORIES)
    return toxicity.score(docs, chain).drop("text")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter(F.pmod("vec_id", F.lit(50)) == 0), k=5)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_leaks(docs, _table(spark, sf_dir, "benchmark")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.json"))
    ids = bpe.encode(docs, vocabulary, bpe.ship_lexicon(docs, vocabulary), keep_text=False)
    return bpe.digest(bpe.decode(ids, vocabulary))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.with_successor(_table(spark, sf_dir, "documents"))
    grouped = rows.join(fingerprints.near_groups(rows), "fingerprint", "left")
    return fingerprints.digest(grouped.withColumn("group_id", F.coalesce("group_id", "doc_id")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.prepare(rows.withColumn("label", label)), F.col("vec_id") % 100 == 0)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return fim.digest(fim.restore(fim.transform(docs).drop("text")))


QUERIES = {f.__name__: f for f in (op1_pii, op2_chat_format, op3_substring_dedup, op4_simhash, op5_secret_scan, op6_toxicity, op7_exact_topk, op8_lm_score,
                                  op9_decontamination, op10_bpe, op11_fingerprints, op12_hard_negatives, op13_fill_in_middle)}
