"""The corpus pipeline: stages that each keep what the next one reads. Every stage takes (spark, docs, sf_dir) and returns a DataFrame;
all but the last return the columns of documents. Decisions belong to rows: rows that repeat an id are told apart by their texts, and null
ids are an id like any other. An empty table stays empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.llm import bagminhash, exact_dedup, mixing, sentencepiece_codec, toxicity
from dossierlake.llm.common import remove, written
from dossierlake.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go. The labels of `labels` train it, as in the operator's own query."""
    trained = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored_rows(docs, trained).where(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the one with the largest doc_id."""
    return exact_dedup.one_of_each(docs, keep="max")


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the smallest doc_id."""
    return bagminhash.one_of_each_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies and cuts that the weights ask for."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests of every row that the mix holds."""
    return sentencepiece_codec.encode_digests(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("mixing", mix_sources), ("sentencepiece", encode)]

#: Noisy-channel decoding and weighted signatures cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet into the shared folder and read back for the next one; what no later stage reads
    is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
            remove(before)
    return docs
