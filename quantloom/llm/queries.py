"""One query for each operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import (
    decontamination, exact_dedup, licenses, mixing, near_dedup, pii, quality, resampling, secret_scan, sharding, toxicity, url_rules, whitening,
)
from quantloom.llm.oracles import EXACT_DEDUP, NEAR_DEDUP, RESAMPLING, mixing_sql
from quantloom.llm.store import landed, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: What is taken in the query: share of all tokens, most epochs of a source, seed.
MIXTURE = (0.8, 4, 7)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", mixing.n_tokens().alias("n"))
    levels, weights = mixing.production_tree()
    mixed = mixing.mix(landed(docs, "tokens"), levels, weights, *MIXTURE, tokens=F.col("n"))
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "epochs", "tokens_taken")


@query
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"))


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8, keep_text=False)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_documents(table(spark, sf_dir, "documents"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(table(spark, sf_dir, "documents"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_of(table(spark, sf_dir, "embeddings"))


@query
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_pages(table(spark, sf_dir, "pages"))


@query
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


# Secret, license and PII scans, sharding (crc32) and the models have no SQL; they are tested against brute force or held-out labels.
ORACLES |= {"op1_mixing": mixing_sql(*MIXTURE), "op7_near_dedup": NEAR_DEDUP, "op8_exact_dedup": EXACT_DEDUP, "op13_resampling": RESAMPLING}
