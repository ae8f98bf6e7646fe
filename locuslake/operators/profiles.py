"""Canonical profiles: one ``ARRAY<INT>`` of allele codes per sample, 0 for missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def alleles_from_columns(cols: list[str]) -> Column:
    """Locus columns as one array; null and values <= 0 become 0."""
    return F.array(*[F.coalesce(F.greatest(F.col(c), F.lit(0)), F.lit(0)).cast("int") for c in cols])


def load_profiles(spark: SparkSession, sf_dir: str, extra: list[str] | None = None, n_loci: int = 64) -> DataFrame:
    """``sample_idx``, the ``extra`` columns, ``alleles`` from the given profile table."""
    df = table(spark, sf_dir, "cgmlst_profile")
    return df.select("sample_idx", *(extra or []), alleles_from_columns([f"l{k}" for k in range(1, n_loci + 1)]).alias("alleles"))


def present(alleles: Column) -> Column:
    """Number of loci with an allele."""
    return F.size(F.filter(alleles, lambda x: x > 0))


def distinct_profiles(profiles: DataFrame) -> DataFrame:
    """Equal profiles as one row: ``alleles``, ``rep`` (smallest sample), ``n`` (copies), combined map-side."""
    return profiles.groupBy("alleles").agg(F.min("sample_idx").alias("rep"), F.count("*").alias("n"))
