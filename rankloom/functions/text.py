"""Column expressions on strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind at either end (Unicode White_Space).
_EDGE = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends; null stays null."""
    return F.regexp_replace(c, _EDGE, "")


def tidy(c: Column) -> Column:
    """strip() in lower case: the form in which untidy keys and names are compared. Null stays null."""
    return F.lower(strip(c))


def tidy_key(c: Column) -> Column:
    """tidy(), and null where nothing is left."""
    return F.nullif(tidy(c), F.lit(""))


def byte_tokens(c: Column) -> Column:
    """Size of a text in tokens of the byte-level tokenizer: its UTF-8 bytes. Null has size 0."""
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def tokens(c: Column) -> Column:
    """Lower-cased runs of [a-z0-9]; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
