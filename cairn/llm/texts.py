"""Small helpers shared by the Arrow-side operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.arrow import slices  # noqa: F401

#: The characters that end a word of letters and digits: ASCII but for 0-9 and a-z; A-Z turns to a-z.
_ALNUM = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)


def space_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode().lower().split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Runs of 0-9, a-z and non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return text.encode().translate(_ALNUM).split() if text else []


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def alnum(text: Column) -> Column:
    """The same words as a column."""
    blank = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    trimmed = F.trim(blank)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " ", -1))
