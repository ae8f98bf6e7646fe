"""Most similar vectors for every vector: shifted Hilbert orderings, window merge, exact rerank.

A profile is projected by linear functions of its alleles (one-hot): random
combinations of a bounded sample of profiles, turned onto their principal
directions, so profiles that share alleles lie close together and families lie
apart. Every ordering turns these coordinates at random, cuts each axis at
shifted quantiles and takes the Hilbert index of the cells. All orderings are
range-partitioned in one shuffle; in a partition every vector is compared, with
the exact distance, with the vectors next to it in key order, and the windows
that reach over a partition's edge are made up of the rows on both sides. The
best of all orderings are merged per vector.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.distance import ALLOWED_MISSING, close_values, masks
from ..session import pin, unpin

FAR = 32000
ID_BITS = 48


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of ``coords`` (rows, axes), by Skilling's transposed form; axes * bits <= 62."""
    x = np.ascontiguousarray(coords.T, np.uint16 if bits > 8 else np.uint8)
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = x.dtype.type(q - 1)
        for i in range(n):
            hit = (x[i] & x.dtype.type(q)) != 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & x.dtype.type(q)) != 0, t ^ x.dtype.type(q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def concatenated(coords: np.ndarray, bits: int) -> np.ndarray:
    """The coordinates of each row written one after the other; what the Hilbert index is measured against."""
    out = np.zeros(len(coords), np.int64)
    for c in coords.T:
        out = (out << bits) | c
    return out


@dataclass
class Projection:
    """Directions for (locus, allele), turns and cuts for every ordering; its size is bounded by the sample and the axes."""

    alleles: list[np.ndarray]  # per locus: the alleles of the sample, sorted
    vectors: list[np.ndarray]  # per locus: a row for each of them
    other: np.ndarray  # rows for alleles outside the sample, by hash
    centre: np.ndarray
    turns: np.ndarray  # orderings, directions, axes
    cuts: np.ndarray  # orderings, axes, 2**bits - 1
    bits: int

    def project(self, profiles: np.ndarray) -> np.ndarray:
        """(rows, directions): the sum of the directions of a profile's alleles; a missing locus adds nothing."""
        out = np.tile(-self.centre, (len(profiles), 1))
        for k, (known, rows) in enumerate(zip(self.alleles, self.vectors, strict=True)):
            a = profiles[:, k]
            at = np.minimum(np.searchsorted(known, a), max(len(known) - 1, 0))
            if not len(known):
                continue
            seen = known[at] == a
            if seen.all():
                out += rows[at]
                continue
            out[seen] += rows[at[seen]]
            new = (a > 0) & ~seen
            if new.any():
                h = (a[new].astype(np.uint64) * np.uint64(64) + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
                out[new] += self.other[(h >> np.uint64(40)) % np.uint64(len(self.other))]
        return out

    def cells(self, projected: np.ndarray, ordering: int) -> np.ndarray:
        """(rows, axes): the cell of each row in one ordering."""
        turned = projected @ self.turns[ordering]
        return np.stack([np.searchsorted(self.cuts[ordering, j], turned[:, j]) for j in range(turned.shape[1])], 1).astype(np.uint8)

    def keys(self, projected: np.ndarray, ordering: int) -> np.ndarray:
        return hilbert_index(self.cells(projected, ordering), self.bits)


def fit_projection(sample: np.ndarray, orderings: int, directions: int = 128, axes: int = 20, bits: int = 3, seed: int = 17) -> Projection:
    """Projection fitted on a bounded ``sample`` (rows, loci) of profiles.

    An allele's direction is the sum of random directions of the sampled profiles
    that have it, so alleles that occur together point the same way. The axes are
    turned to the principal ones and each is scaled to the square root of its spread.
    """
    rng = np.random.default_rng(seed)
    n, loci = sample.shape
    noise = rng.standard_normal((n, directions)).astype(np.float32)
    alleles, vectors, codes = [], [], []
    for k in range(loci):
        known, code = np.unique(sample[:, k], return_inverse=True)
        rows = np.zeros((len(known), directions), np.float32)
        np.add.at(rows, code, noise)
        rows[known <= 0] = 0
        alleles.append(known)
        vectors.append(rows)
        codes.append(code)
    y = sum(v[c] for v, c in zip(vectors, codes, strict=True)) if n else np.zeros((0, directions), np.float32)
    centre = y.mean(0) if n else np.zeros(directions, np.float32)
    _, spread, turn = np.linalg.svd(y - centre, full_matrices=False) if n else (None, np.ones(0), np.zeros((0, directions)))
    scale = (turn.T / np.sqrt(np.maximum(spread, 1e-6 * max(spread.max(initial=0), 1e-9)))).astype(np.float32)
    if scale.shape[1] < directions:
        scale = np.pad(scale, ((0, 0), (0, directions - scale.shape[1])))
    vectors = [v @ scale for v in vectors]
    y = (y - centre) @ scale
    other = rng.standard_normal((4096, directions)).astype(np.float32) * (y.std(0) if n else 1) / np.sqrt(max(loci, 1))
    turns = rng.standard_normal((orderings, directions, axes)).astype(np.float32)
    cuts = np.zeros((orderings, axes, 2**bits - 1), np.float32)
    for t in range(orderings):
        turned = y @ turns[t]
        for j in range(axes):
            at = (np.arange(1, 2**bits) - rng.random()) / 2**bits  # the shift of this axis in this ordering
            if n:
                cuts[t, j] = np.quantile(turned[:, j], at)
    return Projection(alleles, vectors, other.astype(np.float32), (centre @ scale).astype(np.float32), turns, cuts, bits)


def window_best(alleles: np.ndarray, ids: np.ndarray, group: np.ndarray, width: int, k: int, allowed_missing: float = ALLOWED_MISSING) -> np.ndarray:
    """For each row the ``k`` nearest of the ``width`` rows before and after it in its group, as distance << 48 | id, sorted; FAR << 48 fills up."""
    n, loci = alleles.shape
    best = np.full((k, n), FAR << ID_BITS, np.int64)
    if n > 1:
        present = alleles > 0
        # a missing allele equals nothing: each row's is its own negative number
        cols = np.ascontiguousarray(np.where(present, alleles, -1 - np.arange(n, dtype=np.int32)[:, None]).T)
        bits, q = masks(alleles), present.sum(1).astype(np.float64)
        same, equal = np.empty(n, np.uint8 if loci < 256 else np.uint16), np.empty(n, bool)
        for o in range(1, min(width, n - 1) + 1):
            s, e = same[: n - o], equal[: n - o]
            s[:] = 0
            for c in cols:
                np.equal(c[:-o], c[o:], out=e)
                np.add(s, e.view(np.uint8), out=s)
            al = np.bitwise_count(bits[:-o] & bits[o:]).sum(1, dtype=np.int64)
            d = close_values(al, al - s, q[:-o], q[o:], loci, allowed_missing).astype(np.int64)
            d[group[:-o] != group[o:]] = FAR
            d <<= ID_BITS
            for side, new in ((best[:, : n - o], d | ids[o:]), (best[:, o:], d | ids[: n - o])):
                for row in side:  # the entry moves down to its place
                    low = np.minimum(row, new)
                    new = np.maximum(row, new)
                    row[:] = low
    return np.ascontiguousarray(best.T)


def class_neighbours(distinct: DataFrame, k: int = 5, orderings: int = 48, width: int = 64, partition_rows: int = 16_000, sample_rows: int = 4096, allowed_missing: float = ALLOWED_MISSING) -> DataFrame:
    """``rep, d, nb``: for each distinct profile up to ``k`` others, by (d, nb).

    ``distinct``: rep BIGINT in [0, 2^48), alleles ARRAY<INT> of one length. The
    projection is fitted on the ``sample_rows`` profiles with the smallest hash of
    ``rep``; every profile is then in every ordering, and no window looks at more
    than ``2 * width`` rows, so the cost is linear in the rows.
    """
    slim = distinct.select("rep", "alleles")
    spark = slim.sparkSession
    rows = slim.count()
    sample = slim.orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).select("alleles").collect()
    if not sample:
        return slim.select("rep", F.lit(0).alias("d"), F.col("rep").alias("nb"))
    fitted = fit_projection(np.array([r["alleles"] for r in sample], np.int32), orderings)
    shipped = spark.sparkContext.broadcast(cloudpickle.dumps(fitted))  # with its class: executors need not have the package

    loci = len(fitted.alleles)

    def profiles_of(column: pa.Array) -> np.ndarray:
        return np.frombuffer(_bytes(column), np.int32).reshape(len(column), loci)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = pickle.loads(shipped.value)
        for batch in batches:
            a = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(batch.num_rows, loci)
            y = fit.project(a)
            yield pa.RecordBatch.from_arrays([pa.array(fit.keys(y, 0)), batch.column(0), _binary(a)], ["key", "rep", "alleles"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = pickle.loads(shipped.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = fit.project(profiles_of(batch.column(1)))
            for t in range(orderings):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), t, np.int32)), pa.array(fit.keys(y, t)), batch.column(0), batch.column(1)], ["ord", "key", "rep", "alleles"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        if t is None:
            return
        t = t.combine_chunks()
        ids = t["rep"].to_numpy()
        best = window_best(profiles_of(t["alleles"].combine_chunks()), ids, t["ord"].to_numpy(), width, k, allowed_missing)
        none = pa.nulls(len(ids), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(ids), _binary(best), none, none, none, pa.nulls(len(ids), pa.binary())], ["rep", "near", "edge", "at", "ord", "alleles"])
        # the rows beside either edge of the partition, for the windows that reach over it
        pid = TaskContext.get().partitionId()
        for edge, cut in ((pid, t.slice(0, width)), (pid + 1, t.slice(max(0, t.num_rows - width)))):
            m = cut.num_rows
            at = np.arange(m) + (edge == pid) * width
            yield pa.RecordBatch.from_arrays([cut["rep"].combine_chunks(), pa.nulls(m, pa.binary()), pa.array(np.full(m, edge, np.int32)), pa.array(at.astype(np.int32)), cut["ord"].combine_chunks(), cut["alleles"].combine_chunks()], ["rep", "near", "edge", "at", "ord", "alleles"])

    def over(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        ids = t["rep"].to_numpy()
        best = window_best(profiles_of(t["alleles"].combine_chunks()), ids, t["ord"].to_numpy(), width, k, allowed_missing)
        return pa.table({"rep": ids, "near": _binary(best)})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the rows of the last rep seen may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(1)
            lens = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) // 8
            ids, near = np.repeat(batch.column(0).to_numpy(), lens), np.frombuffer(_bytes(column), np.int64)
            if held:
                ids, near = np.concatenate([held[0][0], ids]), np.concatenate([held[0][1], near])
            last = int(np.searchsorted(ids, ids[-1]))
            held = [(ids[last:], near[last:])]
            if last:
                yield _best_of(ids[:last], near[:last], k)
        if held:
            yield _best_of(*held[0], k)

    line = "ord int, key bigint, rep bigint, alleles binary"
    # relatives side by side, so that the copies for the orderings shrink well in the shuffle
    tidy = slim.mapInArrow(packed, "key bigint, rep bigint, alleles binary").repartitionByRange("key", "rep").sortWithinPartitions("key", "rep")
    tidy = pin(tidy.select("rep", "alleles"), "tidy")
    parts = max(1, -(-rows * orderings // partition_rows))
    ranged = tidy.mapInArrow(keyed, line).repartitionByRange(parts, "ord", "key", "rep").sortWithinPartitions("ord", "key", "rep")
    found = pin(ranged.mapInArrow(windows, "rep bigint, near binary, edge int, at int, ord int, alleles binary"), "windows")
    unpin(tidy)
    # an edge has at most 2 * width rows
    edges = found.where("edge is not null").select("edge", "at", "ord", "rep", "alleles").groupBy("edge").applyInArrow(over, "rep bigint, near binary")
    both = found.where("edge is null").select("rep", "near").unionByName(edges)
    # at most (orderings + 2) * k entries a profile
    return both.repartition("rep").sortWithinPartitions("rep").mapInArrow(merged, "rep bigint, d int, nb bigint")


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    size = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(column: pa.Array) -> memoryview:
    """The bytes of a binary column without nulls, one value after the other."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return memoryview(column.buffers()[2] or b"")[ends[0] : ends[-1]]


def _best_of(ids: np.ndarray, near: np.ndarray, k: int) -> pa.RecordBatch:
    """``rep, d, nb``: the ``k`` least distinct entries of each id that are neighbours at all."""
    real = near < (FAR << ID_BITS)
    ids, near = ids[real], near[real]
    order = np.lexsort((near, ids))
    ids, near = ids[order], near[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (near[1:] != near[:-1])
    ids, near = ids[new], near[new]
    start = np.ones(len(ids), bool)
    start[1:] = ids[1:] != ids[:-1]
    at = np.arange(len(ids))
    first = at - np.maximum.accumulate(np.where(start, at, 0)) < k
    ids, near = ids[first], near[first]
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array((near >> ID_BITS).astype(np.int32)), pa.array(near & ((1 << ID_BITS) - 1))], ["rep", "d", "nb"])


def nearest_samples(profiles: DataFrame, k: int = 5, **how) -> DataFrame:
    """``sample_idx, neighbour, d0, place``: up to ``k`` nearest other samples by (d0, sample_idx).

    ``profiles``: sample_idx (unique, not negative), alleles. Equal profiles are
    searched once: a class keeps its first ``k + 1`` samples, which suffice for
    every tie, and each sample takes the first ``k`` of its class's list that are
    not itself. A profile without any allele is at distance 0 from profiles with
    few; a table of one row or none gives no rows; null alleles count as missing,
    rows with a null sample or a null profile are left out; other columns are ignored.
    """
    slim = profiles.where("sample_idx is not null and alleles is not null").select(F.col("sample_idx").cast("long").alias("sample_idx"), F.transform("alleles", lambda x: F.coalesce(F.greatest(x, F.lit(0)), F.lit(0))).alias("alleles"))
    firsts = slim.withColumn("r", F.row_number().over(Window.partitionBy("alleles").orderBy("sample_idx"))).where(F.col("r") <= k + 1)
    classes = pin(firsts.groupBy("alleles").agg(F.sort_array(F.collect_list("sample_idx")).alias("copies")).withColumn("rep", F.col("copies")[0]), "classes")
    pairs = pin(class_neighbours(classes, k, **how), "near")
    others = pairs.join(classes.select(F.col("rep").alias("nb"), F.col("copies").alias("cs")), "nb").groupBy("rep").agg(F.flatten(F.collect_list(F.transform("cs", lambda c: F.struct(F.col("d").alias("d"), c.alias("s"))))).alias("others"))
    own = F.transform("copies", lambda c: F.struct(F.lit(0).alias("d"), c.alias("s")))
    best = classes.join(others, "rep", "left").select("alleles", F.slice(F.array_sort(F.concat(own, F.coalesce("others", F.array().cast("array<struct<d:int,s:bigint>>")))), 1, k + 1).alias("best"))
    # a class with very many samples is split by the adaptive skew join; the other side has one row a class
    each = slim.join(best, "alleles").select("sample_idx", F.posexplode(F.slice(F.filter("best", lambda b: b.s != F.col("sample_idx")), 1, k)).alias("place", "b"))
    return each.select("sample_idx", F.col("b.s").alias("neighbour"), F.col("b.d").alias("d0"), (F.col("place") + 1).alias("place"))


def close_pairs(nearest: DataFrame, within: int) -> DataFrame:
    """``sample_a, sample_b``, smaller first: pairs of which one is among the other's nearest, ``d0`` at most ``within``."""
    return nearest.where(F.col("d0") <= within).select(F.least("sample_idx", "neighbour").alias("sample_a"), F.greatest("sample_idx", "neighbour").alias("sample_b")).distinct()
