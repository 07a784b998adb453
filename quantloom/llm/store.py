"""Intermediate tables in the folder that all executors share, and a few column helpers."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantloom.session import work_path

#: Largest table, in rows, that an operator broadcasts after counting it; a bigger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Largest sum of a text column in such a table, in bytes.
BROADCAST_BYTES = 1 << 25
#: Rows of an Arrow batch that goes to Python.
ARROW_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: it cuts the lineage and outlives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_arrow(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` in batches of at most ARROW_ROWS rows, so that those of long texts stay small.

    The setting is the session's, as the plan is run later; a smaller one is kept.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= ARROW_ROWS:
        df.sparkSession.conf.set(key, ARROW_ROWS)
    return df.mapInArrow(function, schema)


def small(df: DataFrame, rows: int | None = None, long_column: str | None = None) -> DataFrame:
    """A hint to broadcast a table, only where it has been counted and is small; else Spark joins by a shuffle.

    ``long_column`` names a text column whose rows may be of any length; its bytes are counted too.
    """
    size = 0
    if long_column is not None:
        rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(long_column)), F.lit(0))).first()
    elif rows is None:
        rows = df.count()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def crc(column: str) -> Column:
    """crc32 of a column as text; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def held_out(column: str = "doc_id") -> Column:
    return crc(column) % 5 == 0


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, asked of whatever store holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def join_path(*parts: str) -> str:
    return os.path.join(*parts)
