"""Column helpers with fixed meaning at the edges."""

from .scalar import (  # noqa: F401
    bit_and,
    bit_or,
    bit_xor,
    concat,
    concat_skip_nulls,
    current_timestamp_text,
    date_shift,
    day_of,
    exact_avg,
    exact_sum,
    int_div,
    like,
    month_of,
    not_null_or,
    safe_div,
    safe_mod,
    substr,
    truthy,
    xor,
    year_of,
)
