"""Consolidating pairwise matches into groups: hash-to-min on a (vertex, member) table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin, unpin


def hash_to_min(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """``vertex, group_id``: the smallest vertex linked directly or indirectly, for every vertex with a link.

    Each vertex holds a set of vertices, kept as rows and never as an array, so
    no set has to fit into a task. In a round it sends its set to the smallest
    member and that member to all others. The state is stable when every row
    either belongs to its own minimum or holds just that minimum, which is
    tested exactly in the same pass. A hub's rows are joined to one row each
    (its minimum), which the adaptive skew join splits; minima and the distinct
    step combine map-side.

    Null ends and self pairs link nothing (a self pair alone gives no row);
    repeated and turned pairs count once; an empty table gives no rows; extra
    columns are ignored.
    """
    e = edges.select(F.col(f"`{u}`").cast("long").alias("a"), F.col(f"`{v}`").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # each vertex's set: itself and its neighbours
    pairs = e.select(F.explode(F.array(*[F.struct(F.col(x).alias("v"), F.col(y).alias("m")) for x, y in ("ab", "ba", "aa", "bb")])).alias("r")).select("r.*").distinct()
    now = pin(pairs, "htm")
    for _ in range(max_rounds):
        low = now.groupBy("v").agg(F.min("m").alias("low")).withColumnRenamed("v", "lv")
        sent = now.join(low, now.v == low.lv).select("v", "m", "low")
        out = sent.select(
            F.explode(F.array(F.struct(F.col("low").alias("v"), F.col("m").alias("m")), F.struct(F.col("m").alias("v"), F.col("low").alias("m")))).alias("r"),
            ((F.col("low") != F.col("v")) & (F.col("low") != F.col("m"))).alias("moving"),
        )
        new = pin(out.groupBy("r.v", "r.m").agg(F.max("moving").alias("moving")), "htm")
        unpin(now)
        moving = new.where("moving").limit(1).count()
        now = new
        if not moving:
            break
    else:
        raise RuntimeError(f"not stable after {max_rounds} rounds")
    return now.groupBy("v").agg(F.min("m").alias("group_id")).withColumnRenamed("v", "vertex")


def list_links(lists: DataFrame, members: str) -> DataFrame:
    """``u, v`` links that join all members of each list: a star at its smallest member, never all pairs."""
    m = lists.select(F.array_distinct(F.filter(F.col(f"`{members}`"), lambda x: x.isNotNull())).alias("m")).where(F.size("m") > 1)
    return m.select(F.array_min("m").alias("u"), F.explode("m").alias("v")).where("u <> v")
