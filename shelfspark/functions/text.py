"""Input cleaning, hashing, case-blind comparison and substring tests."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters stripped from form text.
STRIPPED = " \t\n\r\0\x0b"
# Fixed values of the source's collation: sharp s weighs as s, characters beyond the basic plane weigh all the same.
SHARP_S = {"ß": "S"}
BEYOND = "\ufffd"

_WHOLE = r"^\s*([+-]?[0-9]+)"
_SCIENTIFIC = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)[eE][+-]?[0-9]+)"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """Form text without the stripped characters; a missing field is empty."""
    return F.btrim(F.coalesce(as_column(c), F.lit("")), F.lit(STRIPPED))


def clean_int(c: Column | str) -> Column:
    """The number ``c`` starts with, at least 0; text without one is 0.

    Leading blanks, a sign and an exponent are read ('1e3' is 1000), anything
    after the number is dropped.  Numbers beyond 64 bits stop at the largest.
    """
    c = F.coalesce(as_column(c), F.lit(""))
    whole, scientific = F.regexp_extract(c, _WHOLE, 1), F.regexp_extract(c, _SCIENTIFIC, 1)
    top = F.lit(2**63 - 1)
    real = scientific.try_cast("double")
    value = (
        F.when(scientific != "", F.when(F.abs(real) < 9.2e18, real.try_cast("bigint")).otherwise(0))
        .when(whole == "", 0)
        .when(whole.startswith("-"), 0)
        .otherwise(F.coalesce(whole.try_cast("bigint"), top))
    )
    return F.greatest(F.lit(0).cast("bigint"), value.cast("bigint"))


def zero_to_null(c: Column | str) -> Column:
    return F.nullif(as_column(c), F.lit(0))


def md5_hex(c: Column | str) -> Column:
    return F.md5(F.coalesce(as_column(c), F.lit("")).cast("binary"))


@functools.cache
def _weights() -> tuple[str, str]:
    """Characters whose weight is another character, and those: the capital of the letter without its accents."""
    plain, weight = [], []
    for code in (*range(0xD800), *range(0xE000, 0x10000)):
        char = chr(code)
        base, *marks = unicodedata.normalize("NFD", char)
        base = base if all(unicodedata.combining(mark) for mark in marks) else char
        upper = SHARP_S.get(char, base.upper())
        upper = upper if len(upper) == 1 else base
        if upper != char:
            plain.append(char)
            weight.append(upper)
    return "".join(plain), "".join(weight)


def ci(c: Column | str) -> Column:
    """The weights of ``c`` as text, alike for names that the source's collation takes as equal, and in its order.

    One weight per character: no case, no accents, sharp s as s, but a letter with a separate accent sign is two
    characters.  Blanks at the end do not count.  A plain text, so it sorts, groups and joins like any other.
    """
    plain, weight = _weights()
    basic = F.regexp_replace(as_column(c), r"[\x{10000}-\x{10FFFF}]", BEYOND)
    return F.rtrim(F.translate(basic, plain, weight))


def contains_ci(text: Column, query: str) -> Column:
    """Literal, case-blind substring test; every text contains the empty query."""
    return F.contains(F.lower(text), F.lit(query.lower()))


def or_dash(c: Column | str) -> Column:
    return F.coalesce(as_column(c).cast("string"), F.lit("—"))
