"""Date and time expressions. Everything is zone-free (``timestamp_ntz``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOCK = r"(?:[ T][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?"
_ISO = r"^[0-9]{4}-[0-9]{1,2}(?:-[0-9]{1,2}" + _CLOCK + r")?$"
_YEAR = r"^[0-9]{4}$"
_COMPACT = r"^([0-9]{4})([0-9]{2})([0-9]{2})$"
_YEAR_FIRST = r"^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})(" + _CLOCK + r")$"
_MONTH_FIRST = r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})(" + _CLOCK + r")$"
_SHORT_YEAR = r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2})$"
_NAMED = r"(?i)^(?:[0-9]{1,2}[ -][a-z]{3}[ -][0-9]{4}|[a-z]{3} [0-9]{1,2},? [0-9]{4})$"


def parse_timestamp(text: Column) -> Column:
    """Text to ``timestamp_ntz`` by a fixed ladder, NULL when nothing fits.

    Accepted: ISO dates and date-times, ``yyyy``, ``yyyyMMdd``, ``yyyy/M/d``,
    ``M/d/yyyy``, ``M-d-yyyy``, ``M/d/yy``, ``d MMM yyyy``, ``MMM d, yyyy``.
    A bare time of day is refused. Each shape is rewritten to ISO and cast, so
    the session time zone plays no part.
    """
    s = F.trim(text)

    def cast(value: Column) -> Column:
        return value.try_cast("timestamp_ntz")

    yy = F.regexp_extract(s, _SHORT_YEAR, 3)
    century = F.when(yy < "69", "20").otherwise("19")
    short = F.concat(century, yy, F.lit("-"), F.regexp_extract(s, _SHORT_YEAR, 1), F.lit("-"), F.regexp_extract(s, _SHORT_YEAR, 2))
    plain = F.regexp_replace(F.regexp_replace(s, "-", " "), ",", "")
    named = F.coalesce(
        F.try_to_timestamp(plain, F.lit("d MMM yyyy")), F.try_to_timestamp(plain, F.lit("MMM d yyyy"))
    ).cast("timestamp_ntz")
    return (
        F.when(s.rlike(_ISO) | s.rlike(_YEAR), cast(s))
        .when(s.rlike(_COMPACT), cast(F.regexp_replace(s, _COMPACT, "$1-$2-$3")))
        .when(s.rlike(_YEAR_FIRST), cast(F.regexp_replace(s, _YEAR_FIRST, "$1-$2-$3$4")))
        .when(s.rlike(_MONTH_FIRST), cast(F.regexp_replace(s, _MONTH_FIRST, "$3-$1-$2$4")))
        .when(s.rlike(_SHORT_YEAR), cast(short))
        .when(s.rlike(_NAMED), named)
    )


def day_ordinal(value: Column) -> Column:
    """Proleptic day number, day 1 = 0001-01-01."""
    return (F.datediff(value.cast("date"), F.lit("0001-01-01").cast("date")) + 1).cast("double")


def time_text(value: Column) -> Column:
    return value.cast("string")


def iso_text(value: Column) -> Column:
    """ISO-8601 text; six fraction digits, only when there is a fraction."""
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(value, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))
