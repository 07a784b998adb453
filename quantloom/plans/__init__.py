from .backtest import BacktestResult, NoTradingDates, run_backtest
from .sweep import SweepSource, SweepStore, parameter_grid, run_sweep

__all__ = ["BacktestResult", "NoTradingDates", "SweepSource", "SweepStore", "parameter_grid", "run_backtest", "run_sweep"]
