"""Configuration objects. They hold scalars only and never touch data."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime

# Default column names and strategy parameters.
PRICE_COLUMNS = ("date", "id", "close")
PREDICTION_COLUMNS = ("release_date", "id", "pred_10d")

# Column defaults per prediction provider. Names given by the caller win; a column the preset does not
# name keeps the default of PREDICTION_COLUMNS.
SOURCE_PRESETS = {
    "numerai": {"date_column": "date", "id_column": "symbol", "pred_column": "meta_model"},
    "release": {"date_column": "release_date", "id_column": "id"},
    "local": {},
}

# Parameter lists of a default sweep.
DEFAULT_GRID = {
    "num_longs": [10, 20, 30, 40, 50],
    "num_shorts": [10, 20, 30, 40, 50],
    "leverages": [1.0, 2.0, 3.0, 4.0, 5.0],
    "rebalance_days": [8, 10, 12],
    "rank_powers": [0.0, 0.5, 1.0, 1.5, 2.0],
}

# Fixed value: fee rate used for estimates when the account's own rate is unknown.
DEFAULT_TAKER_RATE = 0.00035


@dataclass(frozen=True)
class StrategyParams:
    """What a sweep varies."""

    num_long: int = 60
    num_short: int = 50
    leverage: float = 3.0
    rebalance_days: int = 10
    rank_power: float = 0.0


@dataclass(frozen=True)
class BacktestConfig:
    """One backtest: strategy, lag, costs, capital and optional inclusive date bounds."""

    params: StrategyParams = field(default_factory=StrategyParams)
    prediction_lag_days: int = 1
    fee_bps: float = 4.0
    slippage_bps: float = 50.0
    start_capital: float = 100_000.0
    start_date: datetime | None = None
    end_date: datetime | None = None

    @property
    def cost_rate(self) -> float:
        return (self.fee_bps + self.slippage_bps) / 10_000

    def with_params(self, **changes) -> "BacktestConfig":
        return replace(self, params=replace(self.params, **changes))
