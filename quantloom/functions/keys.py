"""Tables that must have one row for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row_each(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The same table; a key that occurs more than once raises an error that names it.

    The count folds map-side and is laid out by the keys, as the joins on them need it anyway.
    """
    values = [c for c in df.columns if c not in keys]
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in values])
    named = F.concat(F.lit(f"Repeated key in {what}: "), F.to_json(F.struct(*keys)))
    # The check hangs on every value, so it stays whichever of them is used.
    return counted.select(*keys, *[F.when(F.col("_n") > 1, F.raise_error(named).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in values])
