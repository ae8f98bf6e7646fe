"""Filling fixed-capacity containers with texts: bound-certified repacking.

Texts are measured in tokens of a public tokenizer; a text longer than a
container is cut into full pieces and a rest. Items are hashed into groups of
bounded size, each packed by best-fit decreasing. Dual feasible functions give
a lower bound on each group's containers: a group that meets its bound is
certified optimal and stays. Groups with a gap exchange the items of their
unfilled containers, hashed anew, and are packed again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin, unpin

#: Fixed value: the published split pattern that goes with the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def token_pieces(docs: DataFrame, doc_id: str, text: str, capacity: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, piece, n_pieces, tokens``: one row per text, or per piece of a text longer than ``capacity``.

    Null and empty texts have 0 tokens. The vocabulary is read once on the
    driver and broadcast (a fixed file of about a megabyte), so executors need
    no copy of it.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        shipped = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shipped.value.splitlines() if line)}
        count = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            sizes = np.array([len(count(t)) if (t := x.as_py()) else 0 for x in batch.column(1)], np.int64)
            pieces = np.maximum(1, -(-sizes // capacity))
            take = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(take)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            tokens = np.minimum(capacity, sizes[take] - piece * capacity)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take)), pa.array(piece.astype(np.int32)), pa.array(pieces[take].astype(np.int32)), pa.array(tokens.astype(np.int32))],
                ["doc_id", "piece", "n_pieces", "tokens"],
            )

    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, piece int, n_pieces int, tokens int")


def lower_bound(sizes: np.ndarray, capacity: int, orders: int = 24) -> int:
    """Containers needed at least: the largest of the bounds by volume, u^(k) and f^(alpha) dual feasible functions."""
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    s = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * s).sum()) // capacity)
    for k in range(1, orders):
        # k times u^(k): (k/capacity) * x where (k+1)x/capacity is whole, else floor((k+1)x/capacity)
        q, r = np.divmod((k + 1) * s, capacity)
        u = np.where(r == 0, k * s, q * capacity)
        best = max(best, -(-int((count * u).sum()) // (k * capacity)))
    volume, number = np.cumsum(count * s), np.cumsum(count)
    a = np.arange(1, capacity // 2 + 1)
    big = number[-1] - number[capacity - a]  # larger than capacity - alpha: one container each
    mid = volume[capacity - a] - volume[a - 1]
    return max([best, *(big - (-mid // capacity)).tolist()])


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """``(container of each item, containers)``; among equal sizes the earlier item first."""
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    for i in order.tolist():
        need = int(sizes[i])
        fits = mask >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            b, room, bins = bins, capacity, bins + 1
        out[i] = b
        free[room - need].append(b)
        mask |= 1 << (room - need)
    return out, bins


PACKED = "doc_id bigint, piece int, n_pieces int, tokens int, grp bigint, bin bigint, fill int, bins bigint, bound bigint"


def _pack_groups(items: DataFrame, capacity: int) -> DataFrame:
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        sizes = pdf["tokens"].to_numpy(np.int64)
        where, bins = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(where, weights=sizes, minlength=bins).astype(np.int64)
        return pdf.assign(bin=where, fill=fill[where].astype(np.int32), bins=bins, bound=lower_bound(sizes, capacity))[[c.split()[0] for c in PACKED.split(", ")]]

    return items.select("doc_id", "piece", "n_pieces", "tokens", "grp").groupBy("grp").applyInPandas(pack, PACKED)


def pack(pieces: DataFrame, capacity: int, group_items: int = 20_000, rounds: int = 4) -> tuple[DataFrame, DataFrame]:
    """``(placed, report)``: a container number for every piece, and per group its containers and lower bound.

    ``pieces``: doc_id, piece, n_pieces, tokens <= capacity. A group has about
    ``group_items`` items whatever the data, so no task grows with the input.
    Items of 0 tokens ride along in any container; rows repeated in the input
    are repeated items; no items give no containers. Container numbers run from
    0 without gaps. An exchange is kept only if it needs fewer containers.
    """
    pieces = pin(pieces, "pieces")
    n = pieces.count()
    salted = lambda df, r, k: df.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", F.lit(r)), F.lit(k)) + F.lit(r << 40))
    now = pin(_pack_groups(salted(pieces, 0, max(1, -(-n // group_items))), capacity), "packed")
    for r in range(1, rounds + 1):
        open_ = now.where((F.col("bins") > F.col("bound")) & (F.col("fill") < capacity))
        used = open_.select("grp", "bin").distinct().count()
        groups = open_.select("grp").distinct().count()
        if groups == 0 or (groups == 1 and r > 1):
            break
        moved = open_.count()
        again = pin(_pack_groups(salted(open_, r, max(1, -(-moved // group_items))), capacity), "again")
        if again.select("grp", "bin").distinct().count() >= used:
            unpin(again)
            break
        stay = now.where((F.col("bins") <= F.col("bound")) | (F.col("fill") >= capacity))
        new = pin(stay.unionByName(again), "packed")
        unpin(now)
        unpin(again)
        now = new
    # settled containers of an exchanged group stay in it, so numbers are counted from what is there
    bins = now.groupBy("grp", "bin").agg(F.count("*").alias("items"), F.sum("tokens").alias("filled"))
    w = Window.partitionBy("grp").orderBy("bin")
    bins = pin(bins.withColumn("k", F.row_number().over(w) - 1).select("grp", F.col("bin").alias("b"), "k", "items", "filled"), "bins")
    per = bins.groupBy("grp").agg(F.count("*").alias("here"), F.sum("filled").alias("filled"), F.sum("items").alias("items"))
    # one row per group, i.e. rows / group_items of them
    start = per.select(F.col("grp").alias("g"), F.coalesce(F.sum("here").over(Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    numbered = bins.join(start, F.col("grp") == F.col("g")).select(F.col("grp").alias("g"), "b", (F.col("start") + F.col("k")).alias("container"))
    # a row per container: shuffled at every size, never broadcast
    placed = now.join(numbered.hint("merge"), (F.col("grp") == F.col("g")) & (F.col("bin") == F.col("b"))).select("doc_id", "piece", "n_pieces", "tokens", "container")
    bounds = now.groupBy("grp").agg(F.max("bound").alias("lower_bound"), F.max("bins").alias("packed_bins"))
    report = per.join(bounds, "grp").select("grp", "items", F.col("here").alias("containers"), "lower_bound", "packed_bins", "filled")
    return placed, report
