"""The queries of this subpackage with production parameters, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlens.llm import bpe, hardneg, html, licenses, linededup, mixing, packing, quality, secrets, simhash, tokenfile, topk, whitening
from pointlens.llm.common import shared_dir, table


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files are: TOKENIZER_DIR, or the package public_tokenizers."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def trusted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of the documents that labels call good."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), trusted_labels(spark, sf_dir)).withColumn("score", F.round("score", 6))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("_id") % 20 == 0)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.quality_weights(docs, table(spark, sf_dir, "labels")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), path, end_id=2)
    return tokenfile.read_documents(spark, path)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("_id") % 7 == 0, (F.col("_label") + 1) % 10).otherwise(F.col("_label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings"), F.col("_id") % 100 == 0, moved)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), shared_dir(spark), end_id=1)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_top_k, op3_line_dedup, op4_bpe, op5_simhash, op6_mix_sources, op7_license_scan, op8_secret_scan, op9_html_text, op10_token_files, op11_hard_negatives, op12_whitening, op13_packing)}

ORACLE_SQL = {
    "op1_quality_rules": quality.ORACLE_SQL,
    "op2_top_k": topk.ORACLE_SQL,
    "op3_line_dedup": linededup.ORACLE_SQL,
    "op6_mix_sources": mixing.ORACLE_SQL,
    "op8_secret_scan": secrets.ORACLE_SQL,
    "op11_hard_negatives": hardneg.ORACLE_SQL,
}
