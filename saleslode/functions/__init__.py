"""Column expressions shared by the operators and plans."""

from saleslode.functions.calendar import (
    calendar_columns,
    date_key,
    day_distance,
    month_of,
    to_day,
)
from saleslode.functions.coerce import (
    decimal_comma_number,
    fixed_date,
    is_finite,
    to_integer,
    to_number,
    to_timestamp_lenient,
)
from saleslode.functions.flags import (
    after,
    before,
    missing_or_negative,
    not_accepted,
    truthy,
)
from saleslode.functions.measures import (
    EXACT,
    MONEY_DIGITS,
    RATE_DIGITS,
    line_total,
    mean_from,
    stable_mean,
    stable_sum,
    sum_when,
)
from saleslode.functions.text import (
    area_of_check,
    forward_slashes,
    has_text,
    label_or_self,
    normalised_text,
    title_words,
)

__all__ = [
    "EXACT", "MONEY_DIGITS", "RATE_DIGITS", "after", "area_of_check", "before",
    "calendar_columns", "date_key", "day_distance", "decimal_comma_number", "fixed_date", "forward_slashes",
    "has_text", "is_finite", "label_or_self", "line_total", "mean_from",
    "missing_or_negative", "month_of", "normalised_text", "not_accepted", "stable_mean",
    "stable_sum", "sum_when", "title_words", "to_day", "to_integer", "to_number",
    "to_timestamp_lenient", "truthy",
]
