"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_PATTERN = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
INFINITY_PATTERN = r"(?i)^[+-]?inf(?:inity)?$"


def parse_number(text: Column) -> Column:
    """Text to double, NULL when it is not a number.

    The pattern comes first because a bare cast also takes suffixed literals
    such as ``12d``.
    """
    stripped = F.trim(text)
    shaped = stripped.rlike(NUMBER_PATTERN) | stripped.rlike(INFINITY_PATTERN)
    return F.when(shaped, stripped.try_cast("double"))


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0.0 where the denominator is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def clamp_unit(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def rounded(value: Column | str, places: int) -> Column:
    """Round to ``places`` decimals by the binary value.

    ``round`` works on the shortest decimal text, so 9 / 60000 (just below
    0.00015 in binary) would go up to 0.0002.
    """
    x = F.col(value) if isinstance(value, str) else value
    x = x.cast("double")
    scale = float(10**places)
    size = F.abs(x) * scale
    return F.when(size < 2.0**52, F.signum(x) * F.floor(size + 0.5) / scale).otherwise(x)


def sample_skew(value: Column) -> Column:
    """Bias-corrected skewness; 0 for constant data, NULL below three values."""
    n = F.count(value).cast("double")
    plain = F.coalesce(F.nanvl(F.skewness(value), F.lit(0.0)), F.lit(0.0))
    return F.when(n >= 3, plain * F.try_divide(F.sqrt(n * (n - 1)), n - 2))


def double_text(value: Column) -> Column:
    """The shortest decimal text of a double: positional for exponents -4..15,
    scientific with a two-digit exponent outside, as Python prints floats."""
    size = F.abs(value)
    raw = value.cast("string")
    positional = F.regexp_replace(raw.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    positional = F.when(positional.endswith("."), F.concat(positional, F.lit("0"))).otherwise(positional)
    large = F.regexp_replace(raw.try_cast("decimal(38,2)").cast("string"), "0$", "")
    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0$", "")
    exponent = F.substring_index(raw, "E", -1)
    sign = F.when(exponent.startswith("-"), "-").otherwise("+")
    digits = F.regexp_replace(exponent, "^-", "")
    padded = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    scientific = F.concat(mantissa, F.lit("e"), sign, padded)
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when((value == 0) | ((size >= 1e-3) & (size < 1e7)), raw)
        .when((size >= 1e7) & (size < 1e16), large)
        .when((size >= 1e-4) & (size < 1e-3), positional)
        .otherwise(scientific)
    )
