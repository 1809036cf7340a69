"""Column expressions (all JVM-side, no Python UDF)."""

from realpay.functions.numbers import clamp, nan_to_null, strict_number
from realpay.functions.ppp import ppp_salary, weighted_index
from realpay.functions.rounding import round_half_away, round_half_even
from realpay.functions.text import normalize_key, split_tokens

__all__ = [
    "clamp",
    "nan_to_null",
    "normalize_key",
    "ppp_salary",
    "round_half_away",
    "round_half_even",
    "split_tokens",
    "strict_number",
    "weighted_index",
]
