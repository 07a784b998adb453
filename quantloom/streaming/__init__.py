from .live import (
    compact, current_predictions, daily_totals, marked_positions, newest_marks, read_latest, running_pnl, totals_until, trailing_totals,
    write_appends, write_changes, write_fill_log,
)

__all__ = ["compact", "current_predictions", "daily_totals", "marked_positions", "newest_marks", "read_latest", "running_pnl",
           "totals_until", "trailing_totals", "write_appends", "write_changes", "write_fill_log"]
