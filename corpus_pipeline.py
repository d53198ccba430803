"""A training corpus from raw documents, in five stages.

1. toxicity: documents that the classifier chain calls toxic go.
2. simhash: of each group of near-duplicates the smallest doc_id stays.
3. decontamination: documents that hold a benchmark item go.
4. pii: personal data is replaced by its kind in angle brackets.
5. bpe: the texts become token ids, and are decoded again.

Each stage is a function (spark, docs, sf_dir) -> DataFrame and gets what the
stage before kept; ``run`` writes every stage's rows to the shared folder and
reads them again, so a lost executor costs at most one stage's tasks. NULL and
empty texts pass all stages (one of all empty texts stays in stage 2).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit.llm import bpe, decontaminate, pii, simhash, toxicity
from churnkit.session import materialize

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.CATEGORIES)
    return toxicity.score(docs, chain).filter(~F.col("toxic")).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, shingle=3, distance=3)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("leaks") == 0).select(*docs.columns)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.find_pii(docs).withColumn("text", F.when(F.size("pii") > 0, pii.mask(F.col("text"), F.col("pii"))).otherwise(F.col("text")))
    return masked.withColumn("n_chars", F.when(F.size("pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary.load(TOKENIZER)
    rows = docs.select("doc_id", "text", "lang", "source")
    ids = bpe.encode(rows, vocabulary, bpe.ship_lexicon(rows, vocabulary), keep_text=False)
    return bpe.decode(ids, vocabulary, into="text").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("pii", mask_pii),
    ("bpe", tokenize),
]

#: No stage but the masking could be written in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
