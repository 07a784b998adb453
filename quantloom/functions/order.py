"""Place of each row in a total order, without sorting a table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_width, work_path


def with_place(df: DataFrame, order: list[Column] | None = None, name: str = "place", parts: int | None = None) -> DataFrame:
    """Rows with their place, from 1, in the given order; without one, in the order in which the table already stands.

    The table is dealt by ranges of the order, sorted within each, and written to the shared folder with a running number for
    each range. The counts of the ranges, one number for each partition, come to the driver and give the offsets. Rows that
    tie in the whole order are numbered among themselves in any way.
    """
    spark = df.sparkSession
    if order is not None:
        df = df.repartitionByRange(parts or shuffle_width(spark), *order).sortWithinPartitions(*order)
    path = work_path(spark, "places")
    df.withColumn("_place_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    part, within = F.shiftright("_place_at", 33).cast("int"), F.col("_place_at").bitwiseAND((1 << 33) - 1)
    counts = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for k in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(k, 0)
    offset = F.element_at(F.lit(offsets).cast("array<bigint>"), part + 1) if offsets else F.lit(0)
    return rows.select(*df.columns, (offset + within + 1).cast("bigint").alias(name))
