"""Session construction and materialisation in the shared folder.

Iterative operators cut lineage by writing a table (``pin``) under the folder
named in ``spark.checkpoint.dir``: every executor can read it, so a lost
executor costs a re-read and not a re-computation. Nothing here keeps state on
an executor's own disk.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "locuslake", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators assume; on a cluster leave ``master`` to spark-submit."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", os.environ.get("LOCUSLAKE_DRIVER_MEMORY", "8g")).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for pinned tables: the cluster's ``spark.checkpoint.dir``, or a fresh one where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every node can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="locuslake-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/locuslake-{sc.applicationId}"


def pin(df: DataFrame, what: str = "t") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: stable rows, no lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    kept = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")  # no later plan reads what the write shuffles
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, kept)
    back = spark.read.schema(df.schema).parquet(path)
    back._pinned_at = path
    return back


def unpin(df: DataFrame | None) -> None:
    """Delete a pinned table that no later plan reads."""
    path = getattr(df, "_pinned_at", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
