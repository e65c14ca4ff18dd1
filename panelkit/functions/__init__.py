from panelkit.functions.expr import (  # noqa: F401
    brackets, bucket_floor, case_when, days_between, first_match_replace, floor_div,
    floor_int, floor_mod, hash_bucket, hash_key, month_start, order_position, plus_days,
    recode, round_half_even_int, trunc_int,
)
from panelkit.functions.frames import normalise_columns, round_doubles  # noqa: F401
