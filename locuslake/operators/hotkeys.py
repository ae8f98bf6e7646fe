"""Per-key results when a few keys hold most rows: exact offset chunking.

Rows are range-partitioned by (key, order column), so a hot key spreads over as
many equal partitions as its rows need. Each partition's count per key is
prefix-summed into offsets, which number every row within its key exactly; a
key is cut into chunks of equal row count; each chunk is folded to a small
state, and the states of a key are merged in order. Distinct counts are exact:
a chunk counts runs of the sorted column, and the merge takes one off where a
chunk starts with the value the chunk before ended with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin


def number_within_key(df: DataFrame, key: str, order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` with ``_n``, the 0-based place of each row within its key.

    Null keys and null order values are values like any other (nulls first). Ties
    in ``order`` are numbered in an arbitrary but fixed order. The row numbers
    come from one pinned range-partitioned pass, so a recomputed task cannot
    change them.
    """
    cols = [F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    ranged = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    placed = pin(ranged.sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    placed = placed.withColumn("_pid", F.shiftright("_at", 33).cast("int"))
    # at most (keys + partitions) rows: a partition holds one contiguous range of keys
    parts = placed.groupBy(key, "_pid").agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    w = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_offset", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    parts = parts.select(F.col(key).alias("_k"), F.col("_pid").alias("_p"), (F.col("_offset") - F.col("_first")).alias("_shift"))
    on = F.col(f"`{key}`").eqNullSafe(F.col("_k")) & (F.col("_pid") == F.col("_p"))
    return placed.join(parts, on).select(*[f"`{c}`" for c in df.columns], (F.col("_at") + F.col("_shift")).alias("_n"))


def chunked_key_stats(
    df: DataFrame,
    key: str,
    distinct: str,
    latest: str,
    members: str | None = None,
    chunk_rows: int = 50_000,
    partitions: int | None = None,
    tie: str | None = None,
) -> DataFrame:
    """Rows, distinct values and latest time for every key, with no key tied to one task.

    Result: ``key, n_rows, n_<distinct>, n_<members>, latest, n_chunks``. Nulls in
    ``distinct``/``members`` count as rows but not as values; an all-null
    ``latest`` gives null; an empty table gives no rows; other columns are
    ignored, whatever their names. Rows of one key and one value (nulls above all)
    are parted by ``tie``, a column that tells rows apart, or else by their hash.
    """
    cols = {"k": key, "d": distinct, "t": latest} | ({"m": members} if members else {})
    slim = df.select(*[F.col(f"`{c}`").alias(a) for a, c in cols.items()], (F.col(f"`{tie}`") if tie else F.xxhash64(*[F.col(f"`{c}`") for c in cols.values()])).alias("tie"))
    rows = number_within_key(slim, "k", ["d", "tie"], partitions).withColumn("chunk", F.floor(F.col("_n") / chunk_rows))
    states = rows.groupBy("k", "chunk", "d").agg(F.count("*").alias("c"), F.max("t").alias("t"), *([F.collect_set("m").alias("ms")] if members else []))
    states = states.groupBy("k", "chunk").agg(
        F.sum("c").alias("n"),
        F.count("d").alias("nd"),
        F.min("d").alias("lo"),
        F.max("d").alias("hi"),
        F.max("t").alias("t"),
        *([F.array_distinct(F.flatten(F.collect_list("ms"))).alias("ms")] if members else []),
    )
    # chunk states: total rows / chunk_rows + keys rows, read twice below
    states = pin(states, "states")
    w = Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    merged = (
        states.withColumn("before", F.max("hi").over(w))  # the last value so far; chunks of nulls only have none
        .groupBy("k")
        .agg(
            F.sum("n").alias("n_rows"),
            (F.sum("nd") - F.coalesce(F.sum(F.when(F.col("before") == F.col("lo"), 1).otherwise(0)), F.lit(0))).alias(f"n_{distinct}"),
            F.max("t").alias("latest"),
            F.count("*").alias("n_chunks"),
        )
    )
    if members:
        per = states.select("k", F.explode("ms").alias("m")).distinct().groupBy("k").agg(F.count("*").alias("_nm"))
        merged = merged.join(per.withColumnRenamed("k", "_k"), F.col("k").eqNullSafe(F.col("_k")), "left").withColumn(f"n_{members}", F.coalesce("_nm", F.lit(0).cast("long"))).drop("_k", "_nm")
    return merged.select(F.col("k").alias(key), "n_rows", f"n_{distinct}", *([f"n_{members}"] if members else []), "latest", "n_chunks")


def heavy_keys(stats: DataFrame, key: str, share: float = 0.03) -> DataFrame:
    """Keys whose ``n_rows`` is at least ``share`` of all rows; at most 1/share of them."""
    total = stats.agg(F.sum("n_rows").alias("_total"))  # one row
    return stats.crossJoin(F.broadcast(total)).where(F.col("n_rows") >= F.lit(share) * F.col("_total")).select(key)


