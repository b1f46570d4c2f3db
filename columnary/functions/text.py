"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import MISSING_LABEL

#: Texts longer than this travel through shuffles as head + length + SHA-256.
LONG_TEXT = 128
#: Characters of its beginning that the key of a long text keeps.
HEAD = 64
_MARK = "\u0001"


def column(name: str) -> Column:
    """A column reference that tolerates dots, spaces and backticks in names."""
    return F.col("`" + name.replace("`", "``") + "`")


def name_tokens(name: Column) -> Column:
    """Lower-cased words of a header: camelCase and punctuation both split."""
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    words = F.split(spaced, "[^A-Za-z0-9]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), F.lower))


def has_any_token(tokens: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))


def normalized_text(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(value)), r"\s+", " ")


def missing_label(value: Column) -> Column:
    return F.coalesce(value, F.lit(MISSING_LABEL))


def text_key(value: Column, notes: Column | None = None) -> Column:
    """A grouping key of bounded width for a text.

    Short texts are their own key. A long text is replaced by its first 64
    characters (kept for a readable sort order), its length and the SHA-256 of
    the *whole* text, so that grouping free text moves about 140 characters per
    row instead of the document. ``notes`` are facts about the whole text that
    travel inside the digest.
    """
    said = F.lit("") if notes is None else notes
    digest = F.concat(
        F.substring(value, 1, HEAD), F.lit(_MARK), said, F.lit(_MARK), F.length(value).cast("string"), F.lit(_MARK), F.sha2(value, 256)
    )
    return F.when(F.length(value) > LONG_TEXT, digest).otherwise(value)


def text_key_notes(key: Column) -> Column:
    """The notes of a digest."""
    return F.element_at(F.split(key, _MARK), -3)


def is_digest(key: Column) -> Column:
    """Only digests are longer than ``LONG_TEXT``."""
    return F.length(key) > LONG_TEXT


def text_key_length(key: Column) -> Column:
    """Length of the original text behind a key."""
    stored = F.element_at(F.split(key, _MARK), -2)
    return F.when(is_digest(key), stored.cast("long")).otherwise(F.length(key).cast("long"))
