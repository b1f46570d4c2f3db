"""Column expressions shared by the operators; all of them stay JVM-side."""

from .dates import day_ordinal, parse_timestamp, time_text
from .numbers import clamp_unit, double_text, parse_number, rounded, safe_ratio, sample_skew
from .text import column, has_any_token, missing_label, name_tokens, normalized_text, text_key, text_key_length, text_key_notes

__all__ = [
    "clamp_unit", "column", "day_ordinal", "double_text", "has_any_token", "missing_label", "name_tokens",
    "normalized_text", "parse_number", "parse_timestamp", "rounded", "safe_ratio", "sample_skew", "text_key",
    "text_key_length", "time_text",
]
