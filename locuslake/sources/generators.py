"""Synthetic profiles and distances, drawn by hashing: the same rows whatever the partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _unit(*parts) -> F.Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def planted_clusters(spark: SparkSession, clusters: int = 3, size: int = 20, loci: int = 50, alleles: int = 100, mutation: float = 0.05, seed: int = 42) -> DataFrame:
    """``name, truth, alleles``: every cluster has its own base profile, every sample its own mutations."""
    base = lambda k: (F.floor(_unit(F.lit(seed), "truth", k) * alleles) + 1).cast("int")
    new = lambda k: (F.floor(_unit(F.lit(seed + 1), "id", k) * alleles) + 1).cast("int")
    rows = spark.range(clusters * size).select("id", F.floor(F.col("id") / size).cast("int").alias("truth"))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(loci - 1)), lambda k: F.when(_unit(F.lit(seed + 2), F.col("id"), k) < mutation, new(k)).otherwise(base(k)))
    return rows.select(F.format_string("C%d_S%03d", "truth", F.pmod("id", F.lit(size))).alias("name"), "truth", drawn.alias("alleles"))


def nested_clusters(spark: SparkSession, size: int = 15, loci: int = 100, alleles: int = 100, changes: tuple[int, int] = (20, 10), mutations: tuple[float, float, float] = (0.02, 0.05, 0.10), seed: int = 42) -> DataFrame:
    """Three clusters, the second close to the first and the third close to the second."""
    rows = spark.range(3 * size).select("id", F.floor(F.col("id") / size).cast("int").alias("truth"))
    draw = lambda salt, k: (F.floor(_unit(F.lit(seed + salt), k) * alleles) + 1).cast("int")

    def base(k):
        second = F.when(k < changes[0], draw(1, k)).otherwise(draw(0, k))
        third = F.when((k >= changes[0]) & (k < sum(changes)), draw(2, k)).otherwise(second)
        return F.when(F.col("truth") == 0, draw(0, k)).when(F.col("truth") == 1, second).otherwise(third)

    rate = F.when(F.col("truth") == 0, mutations[0]).when(F.col("truth") == 1, mutations[1]).otherwise(mutations[2])
    own = lambda k: (F.floor(_unit(F.lit(seed + 4), F.col("id"), k) * alleles) + 1).cast("int")
    drawn = F.transform(F.sequence(F.lit(0), F.lit(loci - 1)), lambda k: F.when(_unit(F.lit(seed + 3), F.col("id"), k) < rate, own(k)).otherwise(base(k)))
    return rows.select(F.format_string("C%d_S%03d", "truth", F.pmod("id", F.lit(size))).alias("name"), "truth", drawn.alias("alleles"))


def random_distances(spark: SparkSession, n: int, most: int = 100, seed: int = 42) -> DataFrame:
    """``i, j, d0`` with ``j < i``: every pair of ``n`` rows, for benchmarks of bounded size."""
    rows = spark.range(n).select(F.col("id").alias("i")).where("i > 0").select("i", F.explode(F.sequence(F.lit(0), F.col("i") - 1)).alias("j"))
    return rows.select("i", "j", F.floor(_unit(F.lit(seed), "i", "j") * (most + 1)).cast("int").alias("d0"))
