"""Reading and writing panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import PREDICTION_COLUMNS, PRICE_COLUMNS, SOURCE_PRESETS
from ..operators.panel import chunk_returns, chunked_prices


def load_table(source: str | DataFrame, spark: SparkSession | None = None,
               schema: T.StructType | str | None = None) -> DataFrame:
    """A DataFrame as it is, or a ``.parquet`` / ``.csv`` path read by its suffix.

    CSV without a schema is sampled for types, which costs one more pass; give the schema for large files.
    """
    if isinstance(source, DataFrame):
        return source
    spark = spark or SparkSession.active()
    if source.endswith(".parquet"):
        return (spark.read.schema(schema) if schema else spark.read).parquet(source)
    if source.endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(source)
    raise ValueError("Unsupported file type. Use .parquet or .csv.")


def canonical_timestamp(df: DataFrame, name: str) -> Column:
    """Timestamps keep their time of day, everything else becomes midnight of its date; both as TIMESTAMP_NTZ."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.col(name).cast("timestamp_ntz")
    return F.col(name).cast("date").cast("timestamp_ntz")


def _panel(df: DataFrame, columns: tuple[str, str, str], names: tuple[str, str, str]) -> DataFrame:
    date, asset, value = columns
    return df.select(
        canonical_timestamp(df, date).alias(names[0]),
        F.col(asset).cast("string").alias(names[1]),
        F.col(value).cast("double").alias(names[2]),
    ).dropna(how="any", subset=[names[0], names[1]]).where(F.col(names[2]).isNotNull())


def price_panel(df: DataFrame, columns: tuple[str, str, str] = PRICE_COLUMNS) -> DataFrame:
    """Canonical prices ``(date, id, close)``; rows with a null are dropped, NaN is kept."""
    return _panel(df, columns, ("date", "id", "close"))


def prediction_panel(df: DataFrame, columns: tuple[str, str, str] = PREDICTION_COLUMNS) -> DataFrame:
    """Canonical predictions ``(pred_date, id, pred)``; rows with a null are dropped, NaN is kept."""
    return _panel(df, columns, ("pred_date", "id", "pred"))


def load_prices(source: str | DataFrame, columns: tuple[str, str, str] = PRICE_COLUMNS,
                spark: SparkSession | None = None) -> DataFrame:
    return price_panel(load_table(source, spark), columns)


def columns_for(provider: str | None = None, date_column: str | None = None, id_column: str | None = None,
                pred_column: str | None = None) -> tuple[str, str, str]:
    """Column names of a prediction table: the caller's, else the provider's preset, else the defaults."""
    if provider is not None and provider not in SOURCE_PRESETS:
        raise ValueError(f"Unknown data source: {provider}")
    preset = SOURCE_PRESETS.get(provider or "local", {})
    date, asset, pred = PREDICTION_COLUMNS
    return (
        date_column or preset.get("date_column", date),
        id_column or preset.get("id_column", asset),
        pred_column or preset.get("pred_column", pred),
    )


def load_predictions(source: str | DataFrame, provider: str | None = None, date_column: str | None = None,
                     id_column: str | None = None, pred_column: str | None = None,
                     spark: SparkSession | None = None) -> DataFrame:
    return prediction_panel(load_table(source, spark), columns_for(provider, date_column, id_column, pred_column))


def load_landed_predictions(path: str, provider: str, spark: SparkSession | None = None, **names: str) -> DataFrame:
    """Predictions of a provider from the Parquet file that a separate download job has landed."""
    return load_predictions(path, provider, spark=spark, **names)


def summarize(df: DataFrame, date_column: str, id_column: str) -> DataFrame:
    """One row: number of rows, columns and distinct assets, first and last date.

    Assets are reduced to distinct ids and per-id ranges first, so a hot asset is folded before the shuffle.
    """
    per_asset = df.groupBy(id_column).agg(
        F.count(F.lit(1)).alias("n"), F.min(date_column).alias("first"), F.max(date_column).alias("last"))
    return per_asset.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(id_column).alias("n_assets"),
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
    ).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write with a header, one file per partition; the reader takes the folder."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_price_table(prices: DataFrame, name: str, path: str | None = None, buckets: int = 64, chunk_days: int = 32) -> None:
    """Store canonical prices as the catalog table ``name``, bucketed by asset and calendar chunk and sorted by date.

    The one shuffle of the panel happens here: the close before a chunk is stored with it, so returns are read off each bucket.
    An asset with much of the panel is spread over as many buckets as it has chunks. ``path`` makes an external table.
    """
    rows = chunked_prices(prices, chunk_days).select("date", "id", "close", F.col("_chunk").alias("chunk"), F.col("_extra").alias("handed_on"))
    # Partitions and buckets are cut by the same hash, so each task writes the one file of its bucket.
    writer = rows.repartition(buckets, "id", "chunk").write.mode("overwrite").bucketBy(buckets, "id", "chunk").sortBy("id", "chunk", "date")
    (writer.option("path", path) if path else writer).format("parquet").saveAsTable(name)


def stored_prices(spark: SparkSession, name: str) -> DataFrame:
    """``(date, id, close)`` of a table by :func:`write_price_table`."""
    return spark.table(name).where(~F.col("handed_on")).select("date", "id", "close")


def stored_returns(spark: SparkSession, name: str) -> DataFrame:
    """The returns of a table by :func:`write_price_table`, without an exchange; for ``returns=`` of backtests and sweeps."""
    return chunk_returns(spark.table(name).withColumnsRenamed({"chunk": "_chunk", "handed_on": "_extra"}))
