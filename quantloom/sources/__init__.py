from .tables import (
    canonical_timestamp, columns_for, load_landed_predictions, load_predictions, load_prices, load_table, prediction_panel,
    price_panel, stored_prices, stored_returns, summarize, write_csv, write_parquet, write_price_table,
)

__all__ = [
    "canonical_timestamp", "columns_for", "load_landed_predictions", "load_predictions", "load_prices", "load_table",
    "prediction_panel", "price_panel", "stored_prices", "stored_returns", "summarize", "write_csv", "write_parquet", "write_price_table",
]
