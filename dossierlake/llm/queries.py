"""The queries of the training-data operators, each with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossierlake.llm import token_store
from dossierlake.llm.ann import nearest
from dossierlake.llm.bagminhash import near_dedup
from dossierlake.llm.common import fresh_path
from dossierlake.llm.exact_dedup import exact_dedup
from dossierlake.llm.html_extract import extract
from dossierlake.llm.license_scan import licence_scan
from dossierlake.llm.lm_score import lm_score
from dossierlake.llm.mixing import mix
from dossierlake.llm.sentencepiece_codec import encode_digests
from dossierlake.llm.toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), every=100, k=10)


def _definition(name: str) -> str:
    with open(vocabulary(name), encoding="utf-8") as f:
        return f.read()


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-store")
    token_store.write_store(_table(spark, sf_dir, "documents"), path, _definition("byte_bpe_50k.json"), end_id=2)
    return token_store.read_digests(spark, path)


def op6_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(_table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        return lm_score(_table(spark, sf_dir, "documents"), f.read())


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), keep="max")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_toxicity": op2_toxicity,
    "op3_html_extract": op3_html_extract,
    "op4_nn_descent": op4_nn_descent,
    "op5_token_store": op5_token_store,
    "op6_bagminhash": op6_bagminhash,
    "op7_license_scan": op7_license_scan,
    "op8_lm_score": op8_lm_score,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_mixing": op10_mixing,
}

ORACLES: dict[str, str] = {
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
