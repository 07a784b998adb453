from .calendar import ceil_day_index, chunk_of, day_index, on_schedule, plus_days
from .keys import one_row_each
from .numeric import order_free_sum, with_half_even, with_perp_price, with_size_up
from .order import with_place

__all__ = [
    "ceil_day_index", "chunk_of", "day_index", "on_schedule", "one_row_each", "order_free_sum", "plus_days",
    "with_half_even", "with_perp_price", "with_place", "with_size_up",
]
