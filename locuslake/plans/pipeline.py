"""From a profile table to clusters, counts and collapsed profiles in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cluster, pairs
from ..session import pin
from ..sources import writers


def run(profiles: DataFrame, out: str, levels: list[int], n_loci: int, target: int | None = None) -> dict[str, str]:
    """Writes ``hierarchy`` (a folder per level), ``group_counts``, and, with a ``target``, ``collapsed``; returns the paths.

    ``profiles``: sample_idx, alleles. ``collapsed`` has one row a sample: its
    representative, the size of its cluster, the threshold, and the representative's
    alleles. Edges go up to the largest level and no further.
    """
    done = {name: f"{out}/{name}" for name in ("hierarchy", "group_counts")}
    samples = pin(profiles.where("sample_idx is not null and alleles is not null").select(F.col("sample_idx").cast("long").alias("sample_idx"), "alleles"), "samples")
    found = pin(pairs.profile_hierarchy(samples, levels, n_loci), "levels")
    writers.write_hierarchy(found.select(F.col("sample_idx").alias("id"), "level", "cluster"), done["hierarchy"])
    found.groupBy("level").agg(F.count_distinct("cluster").alias("n_groups")).write.mode("overwrite").parquet(done["group_counts"])
    if target is not None:
        done["collapsed"] = f"{out}/collapsed"
        edges = pin(pairs.linking_edges(samples.select(F.col("sample_idx").alias("rep"), "alleles"), max(levels), n_loci), "edges")
        flat = cluster.collapse(edges, samples.select(F.col("sample_idx").alias("id")), target)
        flat.join(samples.withColumnRenamed("sample_idx", "rep"), "rep").write.mode("overwrite").parquet(done["collapsed"])
    return done
