"""Scalar text functions, all JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind: Unicode's property and the four information separators.
WS = r"[\p{IsWhite_Space}\x1c-\x1f]"


def strip_ws(c: Column) -> Column:
    """``c`` without white space of any kind at either end."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def organism_key(c: Column, unknown: str = "unknown") -> Column:
    """Trimmed key; ``unknown`` where it is null or nothing is left."""
    s = strip_ws(c)
    return F.when(s.isNull() | (s == ""), F.lit(unknown)).otherwise(s)
