"""Column-level functions: parsing, mapping, banding, calendar, ratios."""

from churnkit.functions.bands import band, range_band, zero_then_band
from churnkit.functions.dates import (
    date_key,
    date_lit,
    day_diff,
    month_name,
    week_of_year_sunday,
    weekday_name,
    weekday_number,
    year_diff,
    year_month,
)
from churnkit.functions.metrics import pct
from churnkit.functions.parse import to_date, to_flag, to_float, to_int, to_int_via_float
from churnkit.functions.text import as_col, folded, map_values, normalized

__all__ = [
    "as_col", "band", "date_key", "date_lit", "day_diff", "folded", "map_values", "month_name", "normalized",
    "pct", "range_band", "to_date", "to_flag", "to_float", "to_int", "to_int_via_float",
    "week_of_year_sunday", "weekday_name", "weekday_number", "year_diff", "year_month", "zero_then_band",
]
