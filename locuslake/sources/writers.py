"""Writing results: hierarchy tables, evaluation reports, collapsed profiles, coordinates, the split by organism."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import safe_name


def write_profiles(profiles: DataFrame, loci: list[str], path: str) -> None:
    """``ST<TAB>locus...`` as compressed text."""
    cols = [F.col("alleles")[i].alias(name) for i, name in enumerate(loci)]
    profiles.select(F.col("st_id").alias("ST"), *cols).write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)


def write_hierarchy(hier: DataFrame, path: str) -> None:
    """Long parquet, one folder per level, so that reading a level touches only its files."""
    hier.repartition("level").sortWithinPartitions("id").write.mode("overwrite").partitionBy("level").parquet(path)


def write_hierarchy_text(hier: DataFrame, levels: list[int], path: str) -> None:
    """``#ST_id<TAB>HC0...`` as compressed text."""
    wide = hier.groupBy("id").pivot("level", levels).agg(F.first("cluster"))
    wide.select(F.col("id").alias("#ST_id"), *[F.col(str(d)).alias(f"HC{d}") for d in levels]).orderBy("#ST_id").write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)


def write_evaluation(sil: DataFrame, nmi: DataFrame, levels: list[int], path: str) -> None:
    """Silhouette lines, a blank line, and the matrix of mutual information with three decimals.

    ``sil``: level, x. ``nmi``: level1, level2, x for level1 < level2. The report has a line per level.
    """
    spark = sil.sparkSession
    name = lambda c: F.concat(F.lit("HC"), c.cast("string"))
    a = sil.select(F.lit(0).alias("part"), F.col("level").alias("o"), F.concat_ws("\t", F.lit("#Silhouette"), name(F.col("level")), F.format_string("%.3f", "x")).alias("value"))
    fixed = spark.createDataFrame([(1, 0, ""), (2, 0, "\t".join(["#NMI", *[f"HC{d}" for d in levels]]))], "part int, o int, value string")
    both = nmi.select("level1", "level2", "x").union(nmi.select("level2", "level1", "x")).union(spark.createDataFrame([(d, d, 0.999) for d in levels], "level1 int, level2 int, x double"))
    wide = both.groupBy("level1").pivot("level2", levels).agg(F.first("x"))
    m = wide.select(F.lit(3).alias("part"), F.col("level1").alias("o"), F.concat_ws("\t", name(F.col("level1")), *[F.format_string("%.3f", F.col(str(d))) for d in levels]).alias("value"))
    reduce(DataFrame.unionByName, [a, fixed, m]).coalesce(1).sortWithinPartitions("part", "o").select("value").write.mode("overwrite").text(path)


def write_collapse_metadata(clusters: DataFrame, threshold: float, path: str) -> None:
    """One JSON document per cluster: cluster, representative, count, members, threshold."""
    clusters.select(F.to_json(F.struct("cluster_id", "rep_idx", F.size("members").alias("sample_counts"), F.col("members").alias("cluster_to_samples"), F.lit(threshold).alias("collapse_threshold"))).alias("value")).write.mode("overwrite").text(path)


def write_coordinates(coords: DataFrame, path: str) -> None:
    coords.write.mode("overwrite").option("header", True).csv(path)


ORGANISM_COLUMNS = ["organismid", "organism_id", "organism"]


def organism_column(columns: list[str]) -> str:
    """The organism column by name, case ignored; the first known name wins."""
    low = {c.lower(): c for c in columns}
    for name in ORGANISM_COLUMNS:
        if name in low:
            return low[name]
    raise ValueError("no organism column")


def split_by_organism(df: DataFrame, key: Column, path: str, overwrite: bool = False, files_rows: int = 1_000_000) -> DataFrame:
    """One folder of compressed CSV per key; returns rows per folder.

    Rows are spread by (key, salt) before the write, so that a key with most
    rows is written by many tasks while a small key gives one file.
    """
    keyed = df.withColumn("folder", safe_name(key))
    counts = keyed.groupBy("folder").agg(F.count("*").alias("n"))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.greatest(F.lit(1), F.ceil(F.col("n") / files_rows)))
    spread = keyed.join(counts, "folder").withColumn("salt", salt).repartition("folder", "salt").drop("n", "salt")
    spread.write.mode("overwrite" if overwrite else "ignore").partitionBy("folder").option("header", True).option("compression", "gzip").csv(path)
    return counts
