"""From profiles to the edges that single linkage needs, without listing all pairs.

Two profiles within a distance share one of their rarest alleles, so profiles
meet only in the lists of such alleles. Long lists are cut into tiles that meet
in tasks of their own, and every task keeps only what joins clusters of what it
found: an edge that is the largest of a cycle decides no level. The lists are
taken in turns, each of about as many rows as there are profiles, and what a
turn moved is deleted before the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin, unpin
from .cluster import hierarchy
from .distance import ALLOWED_MISSING, as_binary, as_matrix, close_values, masks
from .graph import joining_edges

BUCKETS = 4096  # of alleles per locus, for counting


def _slots(alleles: np.ndarray) -> np.ndarray:
    h = alleles.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


def _planes(alleles: np.ndarray) -> pa.Array:
    """Each profile as bytes, the low ones of all loci first: the high ones are mostly zeros and shrink in a shuffle."""
    return as_binary(np.ascontiguousarray(alleles, np.int32).view(np.uint8).reshape(len(alleles), -1, 4).transpose(0, 2, 1).reshape(len(alleles), -1))


def _profiles(column: pa.Array, n_loci: int) -> np.ndarray:
    """The profiles of ``_planes``: (rows, loci) int32."""
    return np.ascontiguousarray(as_matrix(column).view(np.uint8).reshape(len(column), 4, n_loci).transpose(0, 2, 1)).view(np.int32).reshape(len(column), n_loci)


def packed_profiles(profiles: DataFrame, key: str, n_loci: int) -> DataFrame:
    """``key, alleles`` with each profile as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), _planes(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, n_loci))], [key, "alleles"])

    return profiles.where(F.col(key).isNotNull() & F.col("alleles").isNotNull()).select(F.col(key).cast("long").alias(key), "alleles").mapInArrow(run, f"{key} bigint, alleles binary")


def bucket_counts(packed: DataFrame, n_loci: int) -> np.ndarray:
    """Profiles per (locus, bucket of alleles): loci x BUCKETS numbers, whatever the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_loci * BUCKETS, np.int64)
        for b in batches:
            if b.num_rows:
                a = _profiles(b.column(0), n_loci)
                total += np.bincount((_slots(a) + np.arange(n_loci) * BUCKETS)[a > 0], minlength=len(total))
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "c"])

    got = packed.select("alleles").mapInArrow(run, "slot bigint, c bigint").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(n_loci * BUCKETS, np.int64)
    out[got["slot"].to_numpy()] = got["c"].to_numpy()
    return out.reshape(n_loci, BUCKETS)


def rare_alleles(packed: DataFrame, within: int, n_loci: int, allowed_missing: float = ALLOWED_MISSING) -> DataFrame:
    """``rep, alleles, lists``: the buckets of the rarest alleles of each profile, as many as it cannot have all different from a profile within the distance.

    Such profiles agree in at least (1 - (within + .5) / loci) * (present - tolerated)
    loci. A profile with so few alleles that it may agree in none is in the last list as well.
    """
    shipped = packed.sparkSession.sparkContext.broadcast(bucket_counts(packed, n_loci))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loci = np.arange(n_loci)
        for b in batches:
            if not b.num_rows:
                continue
            a = _profiles(b.column(1), n_loci)
            has, slot = a > 0, _slots(a)
            need = _agreeing(has.sum(1), within, n_loci, allowed_missing)
            take = np.where(need > 0, has.sum(1) - need + 1, has.sum(1))
            # rarest first; the allele itself breaks ties, alike in every profile
            rank = (shipped.value[loci, slot] << 32) | a
            rank[~has] = np.iinfo(np.int64).max
            order = np.argsort(rank, axis=1, kind="stable")
            mine = np.concatenate([np.take_along_axis(slot + loci * BUCKETS, order, 1), np.full((len(a), 1), n_loci * BUCKETS)], 1).astype(np.int32)
            here = np.concatenate([loci[None, :] < take[:, None], (need <= 0)[:, None]], 1)
            ends = np.concatenate([[0], np.cumsum(here.sum(1) * 4)]).astype(np.int32)
            lists = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(mine[here]))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["rep", "alleles", "lists"])

    return packed.select("rep", "alleles").mapInArrow(run, "rep bigint, alleles binary, lists binary")


def _agreeing(present: np.ndarray, within: int, n_loci: int, allowed_missing: float) -> np.ndarray:
    """Loci in which a profile agrees at least with any within the distance."""
    return np.ceil(max(0.0, 1 - (within + 0.5) / n_loci) * (present - allowed_missing * n_loci) - 1e-9).astype(np.int64)


def _members(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(row, list)`` of each entry of ``rare_alleles``."""
    ends = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
    return np.repeat(np.arange(len(lists)), np.diff(ends) // 4), np.frombuffer(memoryview(lists.buffers()[2] or b"")[ends[0] : ends[-1]], np.int32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def list_sizes(listed: DataFrame, n_loci: int) -> np.ndarray:
    """Members of each list, 0 for lists of one and for all but one of those with the same members: loci x BUCKETS + 1 numbers, whatever the rows."""
    n = n_loci * BUCKETS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, n), np.uint64)
        for b in batches:
            if b.num_rows:
                row, at = _members(b.column(1))
                rep = _mixed(b.column(0).to_numpy())[row]
                total[0] += np.bincount(at, minlength=n).astype(np.uint64)
                for k in (1, 2):
                    np.add.at(total[k], at, _mixed(rep + np.uint64(k)))
        at = np.nonzero(total[0])[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(t[at].view(np.int64)) for t in total]], ["at", "m", "s1", "s2"])

    # sums of hashes run over, which xor with a half each does not
    halves = [F.sum(F.col(s).bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{s}l") for s in ("s1", "s2")] + [F.sum(F.shiftrightunsigned(s, 32)).alias(f"{s}h") for s in ("s1", "s2")]
    got = listed.select("rep", "lists").mapInArrow(run, "at bigint, m bigint, s1 bigint, s2 bigint").groupBy("at").agg(F.sum("m").alias("m"), *halves).toArrow()
    c = {k: got[k].to_numpy() for k in got.column_names}
    sums = [(c[f"{s}l"].astype(np.uint64) + (c[f"{s}h"].astype(np.uint64) << np.uint64(32))) for s in ("s1", "s2")]
    order = np.lexsort((c["at"], *sums, c["m"]))
    keys = [k[order] for k in (c["m"], *sums)]
    first = np.concatenate([[True], np.any([np.diff(k.view(np.int64)) != 0 for k in keys], axis=0)])[: len(order)]
    out = np.zeros(n, np.int64)
    kept = order[first & (keys[0] > 1)]
    out[c["at"][kept]] = c["m"][kept]
    return out


def _near(alleles: np.ndarray, within: int, allowed_missing: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(x, y, w)``: pairs of rows that join the same clusters as all pairs with d0 <= ``within``, at every level up to it."""
    n, loci = alleles.shape
    has, bits = alleles > 0, masks(alleles)
    present = has.sum(1)
    need = np.maximum(_agreeing(present, within, loci, allowed_missing), 0)
    if alleles.max(initial=0) < 65535:
        codes = alleles.astype(np.uint16)
    else:
        codes = np.stack([np.unique(alleles[:, k], return_inverse=True)[1].astype(np.uint16 if n < 65535 else np.int32) for k in range(loci)], 1)
    at = np.ascontiguousarray(codes.T)
    mine = np.where(has.T, at, np.iinfo(at.dtype).max)  # a missing one equals none
    rows = max(32, min(256, 1_000_000 // max(n, 1)))
    dense, xs, ys, ws, found = None, [], [], [], 0
    for s in range(0, n, rows):
        e = min(n, s + rows)
        same = np.zeros((e - s, n - s), np.uint8 if loci < 256 else np.uint16)
        equal = np.empty(same.shape, bool)
        for k in range(loci):
            np.equal(mine[k, s:e, None], at[k, None, s:], out=equal)
            np.add(same, equal.view(np.uint8), out=same)
        x, y = np.nonzero(same >= need[s:e, None].astype(same.dtype))
        later = y > x
        x, y = x[later], y[later]
        al = np.bitwise_count(bits[s + x] & bits[s + y]).sum(1, dtype=np.int64).astype(float)
        d = close_values(al, al - same[x, y], present[s + x].astype(float), present[s + y].astype(float), loci, allowed_missing)
        ok = d <= within
        x, y, d = s + x[ok], s + y[ok], d[ok]
        found += len(x)
        if dense is None and found > 8 * n and within < 255:
            dense = np.full((n, n), 255, np.uint8)
            for a, b, c in zip(xs, ys, ws, strict=True):
                dense[a, b] = dense[b, a] = c
        if dense is None:
            xs.append(x)
            ys.append(y)
            ws.append(d)
        else:
            dense[x, y] = dense[y, x] = d
    return _tree(dense) if dense is not None else tuple(np.concatenate(c) for c in (xs, ys, ws))


def _tree(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(x, y, w)``: a minimum spanning forest of a symmetric matrix of distances, 255 for none."""
    n = len(d)
    best, by, free = np.full(n, 255, np.uint8), np.zeros(n, np.int64), np.ones(n, bool)
    out = []
    for _ in range(n):
        v = int(best.argmin())
        w = int(best[v])
        if w == 255:  # none is near what was reached: the next one begins a tree
            v = int(free.argmax())
        else:
            out.append((int(by[v]), v, w))
        free[v] = False
        nearer = (d[v] < best) & free
        best[nearer] = d[v][nearer]
        by[nearer] = v
        best[v] = 255
    return tuple(np.array(out, np.int64).reshape(-1, 3).T)


def linking_edges(profiles: DataFrame, within: int, n_loci: int = 64, chunk: int = 4096, allowed_missing: float = ALLOWED_MISSING, turn_rows: int | None = None) -> DataFrame:
    """``u, v, w``: edges between profiles (rep, alleles) that join the same clusters as all pairs with d0 <= ``within``, at every level up to it; pinned.

    Lists of equal members are done once. A list longer than ``chunk`` is cut and
    every two chunks meet in one task, which holds no more than the two. A turn
    moves ``turn_rows`` rows, or a list if that is more. No rows
    give no edges; a profile of missing loci only is compared with those that have few.
    """
    return _linked(pin(packed_profiles(profiles, "rep", n_loci), "profiles"), within, n_loci, chunk, allowed_missing, turn_rows)


def _linked(packed: DataFrame, within: int, n_loci: int, chunk: int = 4096, allowed_missing: float = ALLOWED_MISSING, turn_rows: int | None = None) -> DataFrame:
    """``linking_edges`` of packed profiles, which are unpinned."""
    listed = pin(rare_alleles(packed, within, n_loci, allowed_missing), "lists")
    unpin(packed)
    sizes = list_sizes(listed, n_loci)
    parts = -(-sizes // chunk)
    rows = sizes * np.maximum(parts - 1, 1)
    full = turn_rows or max(1_000_000, 2 * listed.count())
    turns = np.full(len(sizes), -1)
    turns[sizes > 0] = np.unique((np.cumsum(rows)[sizes > 0] - 1) // full, return_inverse=True)[1]
    shipped = listed.sparkSession.sparkContext.broadcast((parts.astype(np.int32), turns.astype(np.int32)))

    def placed(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, turns = shipped.value
            for whole in batches:
                for s in range(0, whole.num_rows, 2048):
                    b = whole.slice(s, 2048)
                    row, at = _members(b.column(2))
                    row, at = row[turns[at] == turn], at[turns[at] == turn]
                    if not len(row):
                        continue
                    reps = b.column(0).to_numpy()
                    p = parts[at].astype(np.int64)
                    h = (_mixed(reps)[row] % p.astype(np.uint64)).astype(np.int64)
                    # a list of one chunk is one tile; else the tiles (h, o) for every other chunk
                    times = np.maximum(p - 1, 1)
                    k = np.repeat(np.arange(len(row)), times)
                    o = np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times)
                    o = np.where(p[k] == 1, 0, o + (o >= h[k]))
                    lo, hi = np.minimum(h[k], o), np.maximum(h[k], o)
                    for t in range(0, len(k), 16384):
                        now = slice(t, t + 16384)
                        yield pa.RecordBatch.from_arrays([pa.array(at[k[now]].astype(np.int32)), pa.array(lo[now].astype(np.int32)), pa.array(hi[now].astype(np.int32)), pa.array(reps[row[k[now]]]), b.column(1).take(pa.array(row[k[now]]))], ["at", "lo", "hi", "rep", "alleles"])

        return run

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def solved() -> None:
            t = pa.concat_tables(held).combine_chunks()
            rep, alleles = t["rep"].to_numpy(), _profiles(t["alleles"].combine_chunks() if t["alleles"].num_chunks != 1 else t["alleles"].chunk(0), n_loci)
            new = np.any([np.diff(t[c].to_numpy()) != 0 for c in ("at", "lo", "hi")], axis=0)
            cut = np.concatenate([[0], np.nonzero(new)[0] + 1, [len(rep)]])
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                x, y, w = _near(alleles[s:e], within, allowed_missing)
                if len(x):
                    found.append((rep[s + x], rep[s + y], w))
            held.clear()

        def joined() -> pa.RecordBatch:
            u, v, w = joining_edges(*(np.concatenate(c) for c in zip(*found, strict=True)))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(w.astype(np.int32))], ["u", "v", "w"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            keys = [t[c].to_numpy() for c in ("at", "lo", "hi")]
            new = np.nonzero(np.any([k != k[-1] for k in keys], axis=0))[0]
            last = int(new[-1]) + 1 if len(new) else 0  # the last tile may go on in the next batch
            if last:
                held.append(t.slice(0, last))
                solved()
            elif held and [held[-1][c][-1].as_py() for c in ("at", "lo", "hi")] != [k[0] for k in keys]:
                solved()
            held.append(t.slice(last))
            if sum(len(x[0]) for x in found) > 400_000:
                yield joined()
        if held:
            solved()
        if found:
            yield joined()

    edges = []
    for turn in range(int(turns.max(initial=-1)) + 1):
        tiles = listed.mapInArrow(placed(turn), "at int, lo int, hi int, rep bigint, alleles binary").repartition("at", "lo", "hi").sortWithinPartitions("at", "lo", "hi")
        edges.append(pin(tiles.mapInArrow(solve, "u bigint, v bigint, w int"), "edges"))
    every = reduce(DataFrame.unionByName, edges, listed.sparkSession.createDataFrame([], "u bigint, v bigint, w int"))
    least = pin(every.groupBy("u", "v").agg(F.min("w").alias("w")), "edges")
    for t in (listed, *edges):
        unpin(t)
    return least


def profile_hierarchy(profiles: DataFrame, levels: list[int], n_loci: int = 64) -> DataFrame:
    """``sample_idx, level, cluster``: single-linkage clusters of all samples at each level, straight from profiles; the smallest sample names a cluster.

    Equal profiles are one vertex; ``profiles``: sample_idx, alleles. A row per
    level is written out at the end only.
    """
    packed = pin(packed_profiles(profiles, "sample_idx", n_loci), "packed")
    distinct = pin(packed.groupBy("alleles").agg(F.min("sample_idx").alias("rep")), "distinct")
    copies = pin(packed.join(distinct, "alleles").select("sample_idx", F.col("rep").alias("id")), "copies")
    unpin(packed)
    edges = _linked(distinct, max(levels), n_loci)
    return hierarchy(edges, copies, levels, keep=("sample_idx",)).select("sample_idx", "level", "cluster")
