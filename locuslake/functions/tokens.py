"""Allele token functions: splitting, integer mapping, identifiers, names - column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2147483647


def split_tokens(c: Column) -> Column:
    """Commas count as underscores; null is one empty token."""
    return F.split(F.translate(F.coalesce(c, F.lit("")), ",", "_"), "_")


def pad(tokens: Column, width: Column) -> Column:
    """Ragged token lists filled with '' to ``width``."""
    return F.concat(tokens, F.array_repeat(F.lit(""), F.greatest(width - F.size(tokens), F.lit(0)).cast("int")))


def _hex_mod(c: Column, digits: int) -> Column:
    """First ``digits`` hexadecimal digits modulo 2^31 - 1, in two exact halves."""
    s = F.lpad(F.substring(c, 1, digits), 16, "0")
    hi, lo = (F.conv(F.substring(s, a, 8), 16, 10).cast("bigint") for a in (1, 9))
    return (hi * F.lit((1 << 32) % MODULUS) + lo) % MODULUS


def token_to_int(c: Column) -> Column:
    """'' and 'nan' give null; digits their value; 8 or more hexadecimal digits the first 16 modulo 2^31 - 1; others a stable hash."""
    t = F.lower(F.trim(c))
    return (
        F.when((t == "") | (t == "_") | (t == "nan"), F.lit(None).cast("bigint"))
        .when(t.rlike("^[0-9]{1,18}$"), t.cast("decimal(20,0)").cast("bigint"))
        .when(t.rlike("^[0-9a-f]{8,}$"), _hex_mod(t, 16))
        .otherwise(_hex_mod(F.md5(t), 15))
    )


def numeric_allele(c: Column) -> Column:
    """Value of a plain allele number in [0, 1e9]; '', '0' and '-...' are 0; other tokens null."""
    t = F.trim(c)
    n = F.expr("null").cast("bigint")
    return F.when(t.isNull() | (t == "") | (t == "0") | t.startswith("-"), F.lit(0).cast("bigint")).when(t.rlike("^[0-9]{1,10}$"), F.when(t.cast("decimal(12,0)") <= 1_000_000_000, t.cast("decimal(12,0)").cast("bigint")).otherwise(n)).otherwise(n)


def numeric_suffix(c: Column) -> Column:
    """Digits at the end of a label as a number; null if there are none."""
    s = F.regexp_extract(F.trim(c), "([0-9]{1,18})$", 1)
    return F.when(s != "", s.cast("bigint"))


def clean_id(c: Column) -> Column:
    """An identifier without blanks at the ends and without leading '#'."""
    return F.regexp_replace(F.trim(c), "^#+", "")


def safe_name(c: Column, longest: int = 200) -> Column:
    """A text made fit for a path: blanks and slashes to '_', other odd characters to '_', runs collapsed, cut."""
    s = F.regexp_replace(F.trim(c), r"[\s/\\]+", "_")
    s = F.regexp_replace(s, r"[^0-9A-Za-z_.-]", "_")
    return F.substring(F.regexp_replace(s, "_+", "_"), 1, longest)


def effect_size(d: Column) -> Column:
    """Name of the size of an effect."""
    a = F.abs(d)
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def stars(p: Column, alpha: float = 0.05) -> Column:
    """Significance marks."""
    return F.when(p < alpha / 1000, "***").when(p < alpha / 100, "**").when(p < alpha, "*").otherwise("ns")
