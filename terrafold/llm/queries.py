"""Queries of the operators over the driver's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, hard_negatives, host_rules, line_dedup, oracles, pii, quality_crf, simhash, token_counts, token_ids, toxicity, url_rules, whitening
from .common import bucket


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.token_ids(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model).select("doc_id", F.coalesce(bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "line_dedup.*", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_rules(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 6))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(table(spark, sf_dir, "documents")))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base kinds of op9 alone, which SQL can express."""
    return op9_pii(spark, sf_dir).drop("spans", "scores")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_crf.fit(docs, table(spark, sf_dir, "labels"))
    return quality_crf.quality(docs, model).select("doc_id", F.coalesce(bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


#: Fixed values of the rules: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), k=4)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


QUERIES = {f.__name__: f for f in (op1_token_ids, op2_bpe, op3_toxicity, op4_line_dedup, op5_decontamination, op6_simhash, op7_host_rules, op8_token_counts, op9_pii, op10_quality, op11_url_rules, op12_whitening, op13_hard_negatives, pii_base)}
ORACLES: dict[str, str] = {"op5_decontamination": oracles.DECONTAMINATION, "op7_host_rules": oracles.HOST_RULES, "pii_base": oracles.PII, "op11_url_rules": oracles.url_rules(URL_RULES), "op13_hard_negatives": oracles.HARD_NEGATIVES}
