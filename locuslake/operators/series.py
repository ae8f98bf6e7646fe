"""Ordered series of level metrics: plateaus, peaks, scaling, breakpoint scores, thresholds.

A series has one row per level (``idx`` from 0, ``x``), so its windows are small
however large the data it was computed from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by_idx():
    return Window.orderBy("idx")



def plateaus(series: DataFrame, tol: float = 1e-3, min_len: int = 2) -> DataFrame:
    """``start, end`` (end excluded) of maximal runs whose steps are at most ``tol``: gaps and islands."""
    step = F.abs(F.col("x") - F.lag("x").over(_by_idx()))
    isle = F.sum(F.when(step <= tol, 0).otherwise(1)).over(_by_idx().rowsBetween(Window.unboundedPreceding, 0))
    return series.withColumn("isle", isle).groupBy("isle").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end")).where(F.col("end") - F.col("start") >= min_len).select("start", "end")


def peaks(series: DataFrame, height: float, prominence: float) -> DataFrame:
    """``idx, x, prominence`` of local maxima; a flat top counts at its middle, ends do not count."""
    run = F.sum(F.when(F.col("x") == F.lag("x").over(_by_idx()), 0).otherwise(1)).over(_by_idx().rowsBetween(Window.unboundedPreceding, 0))
    runs = series.withColumn("run", run).groupBy("run").agg(F.floor((F.min("idx") + F.max("idx")) / 2).alias("idx"), F.first("x").alias("x"), F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    w = Window.orderBy("run")
    tops = runs.withColumn("l", F.lag("x").over(w)).withColumn("r", F.lead("x").over(w)).where("x > l and x > r").where(F.col("x") >= height)
    other = series.select(F.col("idx").alias("oi"), F.col("x").alias("ox"))
    edge = tops.join(other, F.col("ox") > F.col("x"), "left").groupBy("idx", "x", "lo", "hi").agg(F.max(F.when(F.col("oi") < F.col("lo"), F.col("oi"))).alias("bl"), F.min(F.when(F.col("oi") > F.col("hi"), F.col("oi"))).alias("br"))
    span = edge.join(other, (F.col("oi") > F.coalesce("bl", F.lit(-1))) & (F.col("oi") < F.coalesce("br", F.lit(2**31 - 1))))
    base = span.groupBy("idx", "x").agg(F.min(F.when(F.col("oi") <= F.col("idx"), F.col("ox"))).alias("ml"), F.min(F.when(F.col("oi") >= F.col("idx"), F.col("ox"))).alias("mr"))
    return base.select("idx", "x", F.round(F.col("x") - F.greatest("ml", "mr"), 6).alias("prominence")).where(F.col("prominence") >= prominence)


def scaled(series: DataFrame) -> DataFrame:
    """``idx, x`` scaled to [0, 1] by its range where its maximum is positive."""
    all_ = Window.partitionBy()
    lo, hi = F.min("x").over(all_), F.max("x").over(all_)
    return series.select("idx", F.round(F.when((hi > 0) & (hi > lo), (F.col("x") - lo) / (hi - lo)).otherwise(F.col("x")), 6).alias("x"))


def breakpoint_scores(sil: DataFrame, nmi_next: DataFrame, n: int = 5, height: float = 0.15, prominence: float = 0.03) -> DataFrame:
    """``idx, score`` of the best peaks of the silhouette: 0.6 scaled silhouette + 0.4 scaled drop of information to the next level."""
    drop = nmi_next.select("idx", (1 - F.col("x")).alias("d"))
    top = Window.partitionBy()
    both = scaled(sil).join(drop, "idx", "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    score = 0.6 * F.col("x") + 0.4 * F.coalesce(F.col("d") / F.nullif(F.max("d").over(top), F.lit(0.0)), F.lit(0.0))
    scored = both.select("idx", F.round(score, 6).alias("score"))  # scaled over all levels, then only peaks are kept
    return scored.join(peaks(sil, height, prominence).select("idx"), "idx", "left_semi").orderBy(F.desc("score"), "idx").limit(n)


def first_two(candidates: DataFrame) -> DataFrame:
    """One row ``first, second``: the two smallest distinct candidates (second falls back to first; none: 0 and null)."""
    return candidates.select("idx").distinct().agg(F.sort_array(F.collect_set("idx")).alias("c")).select(F.coalesce(F.get("c", F.lit(0)), F.lit(0)).alias("first"), F.coalesce(F.get("c", F.lit(1)), F.get("c", F.lit(0))).alias("second"))
