"""Streams: submissions split as they arrive, and new samples assigned to clusters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import organism_key
from ..operators.graph import components, valid_edges
from ..session import pin, unpin
from ..sources.writers import split_by_organism


def loads_per_window(stream: DataFrame, width: str = "30 days", late: str = "30 days") -> DataFrame:
    """Rows per organism key and window of load time; rows later than ``late`` are left to the batch job."""
    return stream.withColumn("at", F.col("loaded_at").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", width).alias("w"), organism_key(F.col("organismid")).alias("organism_key")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "organism_key", "n")


def split_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each micro-batch becomes its own folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        split_by_organism(batch, organism_key(F.col("organismid")), f"{path}/batch={epoch}", overwrite=True)

    return write


def assignment_sink(path: str, level: int) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for streams of compared pairs: joins clusters along the new edges within the level.

    Edges go to ``path``/edges/epoch=N, labels of all samples so far to
    ``path``/labels/epoch=N. Only the new edges are solved, between the labels of
    the epoch before; a repeated batch replaces its own folders.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = pin(valid_edges(batch).where(F.col("w") <= level), "fresh")
        fresh.write.mode("overwrite").parquet(f"{path}/edges/epoch={epoch}")
        ids = fresh.select(F.explode(F.array("u", "v")).alias("id")).distinct()
        before = spark.createDataFrame([], "id bigint, label bigint")
        if epoch > 0 and _exists(spark, f"{path}/labels"):
            kept = spark.read.parquet(f"{path}/labels").where(F.col("epoch") < epoch)
            newest = kept.agg(F.max("epoch")).first()[0]
            if newest is not None:
                before = kept.where(F.col("epoch") == newest).select("id", "label")
        now = before.unionByName(ids.join(before, "id", "left_anti").select("id", F.col("id").alias("label")))
        now = pin(now, "labels")
        of = lambda c: now.select(F.col("id").alias(c), F.col("label").alias(f"{c}{c}"))
        joined = components(fresh.join(of("u"), "u").join(of("v"), "v").select(F.col("uu").alias("u"), F.col("vv").alias("v"))).withColumnsRenamed({"id": "old", "label": "new"})
        out = now.join(joined, F.col("label") == F.col("old"), "left").select("id", F.coalesce("new", "label").alias("label"))
        out.write.mode("overwrite").parquet(f"{path}/labels/epoch={epoch}")
        unpin(fresh)
        unpin(now)

    return write


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
