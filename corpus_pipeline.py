"""From raw documents to training shards: reject, deduplicate, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's
documents. All but the last return the columns of documents. ``run`` applies the stages to the documents table.

Columns that the stages do not know travel in one struct beside them, so they may have any name, and come back as they were; in
the last stage one that has the name of a result (shard, slot, law, size, text_crc32) comes back as ``documents_<name>``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import decontamination, mixing, near_dedup, quality, sharding
from quantloom.llm.store import landed, table


#: The columns that the stages read.
KNOWN = ["doc_id", "text", "lang", "source"]
EXTRA = "_documents_extra"


def beside(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that sees the known columns and one struct of all others, which are put back afterwards."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in KNOWN]
        if not others:
            return stage(spark, docs, sf_dir)
        out = stage(spark, docs.select(*KNOWN, F.struct(*[F.col(f"`{c}`") for c in others]).alias(EXTRA)), sf_dir)
        results = [c for c in out.columns if c not in (*KNOWN, EXTRA)]
        back = {c: F.col(f"{EXTRA}.`{c}`").alias(f"documents_{c}" if c in results else c) for c in others}
        return out.select(*[back.get(c, F.col(f"`{c}`")) for c in docs.columns], *results)

    run_stage.__doc__ = stage.__doc__
    return run_stage


@beside
def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels of what is there, does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@beside
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep_one(docs)


@beside
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


@beside
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken, in whole or with their beginning, by a mixture of 90 % of the tokens; each at most once, as copies
    have just been removed. A document on the edge of its source's budget is kept whole."""
    return mixing.mix_documents(docs, fraction=0.9, max_epochs=1).select(*docs.columns)


@beside
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot along the Hilbert curve."""
    return sharding.shard_documents(docs, shards=8)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", reject_low_quality), ("near_dedup", drop_near_duplicates), ("decontamination", drop_leaks), ("mixing", mix_sources),
    ("sharding", shard)]

#: The classifier's scores can't be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
