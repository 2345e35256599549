"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import embedding_dedup, quality, secret_scan, sentencepiece_bpe, simhash, source_mix, toxicity, url_rules, va_topk, warc
from .common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s[0], s[1])), ",")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), spans.alias("spans"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"), url_rules.rules_table(spark, url_rules.RULES))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest_documents(_table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digest_documents(_table(spark, sf_dir, "documents"), piece_model())


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score_documents(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_topk.top_k(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_url_rules": op2_url_rules,
        "op3_simhash": op3_simhash,
        "op4_secrets": op4_secrets,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_quality": op6_quality,
        "op7_mix": op7_mix,
        "op8_warc": op8_warc,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_top_k": op10_top_k,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_rules": url_rules.SQL, "op7_mix": source_mix.SQL, "op8_warc": warc.SQL, "op9_embedding_dedup": embedding_dedup.SQL, "op10_top_k": va_topk.SQL}
