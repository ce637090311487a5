"""Token and number functions as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U64_MAX = 18446744073709551615
#: Unsigned 64-bit numbers don't fit a long.
U64 = "decimal(20,0)"


def whitespace_tokens(text: Column) -> Column:
    """The parts between runs of Unicode white space; an edge may give an empty one, to be dropped after exploding."""
    return F.split(text, r"\p{IsWhite_Space}+")


def alphanumeric_tokens(text: Column) -> Column:
    """The parts between runs of what is neither a letter (Unicode Alphabetic) nor a number (N*)."""
    return F.split(text, r"[^\p{IsAlphabetic}\p{N}]+")


def parse_u64(token: Column) -> Column:
    """The value of an optional '+' and ASCII digits, up to 2**64 - 1, as decimal(20,0); else null."""
    digits = F.regexp_replace(token, r"\A\+?0*(?=[0-9])", "")
    value = F.when(token.rlike(r"\A\+?[0-9]+\z") & (F.length(digits) <= 20), digits).try_cast("decimal(38,0)")
    return F.when(value <= F.lit(str(U64_MAX)).cast("decimal(38,0)"), value.cast(U64))
