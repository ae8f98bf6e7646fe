"""Allelic distances between profiles: expression form for pair tables, NumPy form for blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOWED_MISSING = 0.05


def dual_distance_columns(a: str, b: str, n_loci: int, allowed_missing: float = ALLOWED_MISSING) -> list[Column]:
    """``d0`` (symmetric) and ``d1`` (query side: ``a`` against the earlier ``b``)."""
    al = F.expr(f"double(aggregate(zip_with({a},{b},(x,y)->int(x>0 and y>0)),0,(s,x)->s+x))") + 1e-12
    ad = F.expr(f"double(aggregate(zip_with({a},{b},(x,y)->int(x>0 and y>0 and x<>y)),0,(s,x)->s+x))")
    ql, rl = (F.expr(f"double(size(filter({c},x->x>0)))") for c in (a, b))
    gap = F.lit(float(allowed_missing * n_loci))

    def corrected(most: Column) -> Column:
        pen = F.greatest(most - gap - al, F.lit(0.0))
        return F.floor((ad + pen) / (al + pen) * n_loci + 0.5).cast("int")

    return [corrected(F.greatest(ql, rl)).alias("d0"), corrected(ql).alias("d1")]


def p_distance_column(a: str, b: str, n_loci: int) -> Column:
    """Poisson-corrected distance in hundredths of a locus; no correction for missing loci."""
    al = F.expr(f"double(aggregate(zip_with({a},{b},(x,y)->int(x>0 and y>0)),0,(s,x)->s+x))")
    ad = F.expr(f"double(aggregate(zip_with({a},{b},(x,y)->int(x>0 and y>0 and x<>y)),0,(s,x)->s+x))")
    return F.floor(-F.log(1 - (ad + 0.5) / (al + 1.0)) * n_loci * 100 + 0.5).cast("int").alias("p")


def profile_bytes(profiles: DataFrame, key: str = "sample_idx") -> DataFrame:
    """``key, alleles`` with each profile as bytes, which cross the shuffle and reach NumPy without a step per element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column(0), as_binary(a)], [key, "alleles"])

    return profiles.where(F.col(key).isNotNull() & F.col("alleles").isNotNull()).select(key, "alleles").mapInArrow(run, f"{key} bigint, alleles binary")


def as_binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    size = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def as_matrix(column: pa.Array) -> np.ndarray:
    """The profiles of a binary column without nulls: (rows, loci) int32."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(memoryview(column.buffers()[2] or b"")[ends[0] : ends[-1]], np.int32).reshape(len(column), -1)


def pair_distances(pairs: DataFrame, profiles: DataFrame, n_loci: int, allowed_missing: float = ALLOWED_MISSING) -> DataFrame:
    """``i, j, d0, d1, p`` for a table of pairs of ``sample_idx``; pairs without both profiles give no row.

    The counts behind all three are worked out once for whole Arrow batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                part = batch.slice(s, 4096)
                a, b = as_matrix(part.column(2)), as_matrix(part.column(3))
                pa_, pb_ = a > 0, b > 0
                both = pa_ & pb_
                al, ad = both.sum(1).astype(np.float64), (both & (a != b)).sum(1).astype(np.float64)
                ql, rl = pa_.sum(1).astype(np.float64), pb_.sum(1).astype(np.float64)
                d0 = close_values(al, ad, ql, rl, n_loci, allowed_missing)
                d1 = close_values(al, ad, ql, ql, n_loci, allowed_missing)
                p = np.floor(-np.log(1 - (ad + 0.5) / (al + 1.0)) * n_loci * 100 + 0.5).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(d0), pa.array(d1), pa.array(p)], ["i", "j", "d0", "d1", "p"])

    packed = profile_bytes(profiles)
    a = packed.select(F.col("sample_idx").alias("i"), F.col("alleles").alias("ai"))
    b = packed.select(F.col("sample_idx").alias("j"), F.col("alleles").alias("aj"))
    long = pairs.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))
    return long.join(a, "i").join(b, "j").select("i", "j", "ai", "aj").mapInArrow(run, "i bigint, j bigint, d0 int, d1 int, p int")


def masks(alleles: np.ndarray) -> np.ndarray:
    """Presence bits of each row, 64 loci to a word: (rows, words) uint64."""
    n, loci = alleles.shape
    words = -(-loci // 64)
    bits = np.zeros((n, words * 64), np.uint8)
    bits[:, :loci] = alleles > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def close_values(al: np.ndarray, ad: np.ndarray, ql: np.ndarray, rl: np.ndarray, n_loci: int, allowed_missing: float = ALLOWED_MISSING) -> np.ndarray:
    """d0 from the four counts, elementwise, in the defining order of operations."""
    al = al + 1e-12
    pen = np.maximum(np.maximum(ql, rl) - allowed_missing * n_loci - al, 0.0)
    return np.floor((ad + pen) / (al + pen) * n_loci + 0.5).astype(np.int32)


def block_d0(a: np.ndarray, b: np.ndarray, allowed_missing: float = ALLOWED_MISSING) -> np.ndarray:
    """d0 of every row of ``a`` against every row of ``b``: (len(a), len(b)) int32."""
    loci = a.shape[1]
    small = np.uint8 if loci < 256 else np.uint16
    same = np.zeros((len(a), len(b)), small)
    al = np.zeros((len(a), len(b)), np.uint16)
    pa_, pb_ = a > 0, b > 0
    at, bt = np.ascontiguousarray(a.T), np.ascontiguousarray(np.where(pb_, b, -1).T)
    for k in range(loci):
        same += (at[k][:, None] == bt[k][None, :]).view(np.uint8)
    ma, mb = masks(a), masks(b)
    for w in range(ma.shape[1]):
        al += np.bitwise_count(ma[:, w][:, None] & mb[:, w][None, :])
    al = al.astype(np.float64)
    return close_values(al, al - same, pa_.sum(1)[:, None].astype(float), pb_.sum(1)[None, :].astype(float), loci, allowed_missing)


def block_within(a: np.ndarray, b: np.ndarray, within: int, allowed_missing: float = ALLOWED_MISSING, rows: int = 128) -> np.ndarray:
    """Whether d0 <= ``within``: (len(a), len(b)) bool.

    Such pairs agree in more than (1 - (within + .5) / loci) * (present - tolerated) loci,
    so the exact distance is worked out only for pairs that agree in that many.
    """
    loci = a.shape[1]
    out = np.zeros((len(a), len(b)), bool)
    bt = np.ascontiguousarray(np.where(b > 0, b, -1).T)
    qa, qb = (a > 0).sum(1), (b > 0).sum(1)
    ma, mb = masks(a), masks(b)
    need = np.ceil(max(0.0, 1 - (within + 0.5) / loci) * np.maximum(qa - allowed_missing * loci, 0) - 1e-9).astype(np.int64)
    for s in range(0, len(a), rows):
        at = np.ascontiguousarray(a[s : s + rows].T)
        equal = np.empty((at.shape[1], len(b)), bool)
        same = np.zeros(equal.shape, np.uint8 if loci < 256 else np.uint16)
        for k in range(loci):
            np.equal(at[k][:, None], bt[k][None, :], out=equal)
            np.add(same, equal.view(np.uint8), out=same)
        r, c = np.nonzero(same >= need[s : s + rows, None].astype(same.dtype))
        if not len(r):
            continue
        both = np.bitwise_count(ma[s + r] & mb[c]).sum(1, dtype=np.int64).astype(float)
        near = close_values(both, both - same[r, c], qa[s + r], qb[c], loci, allowed_missing) <= within
        out[s + r[near], c[near]] = True
    return out
