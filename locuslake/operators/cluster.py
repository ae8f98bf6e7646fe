"""Clusterings of a pair table: threshold hierarchy, cuts and collapse, density clustering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin, unpin
from .evaluate import silhouettes
from .graph import components, level_paths, level_tree, renamed, spanning_forest, symmetrised
from .hotkeys import number_within_key


def labels_at(edges: DataFrame, nodes: DataFrame, level: float, strict: bool = False) -> DataFrame:
    """``id, label`` for every node: components of the edges with ``w <= level`` (``<`` if strict)."""
    near = edges.where(F.col("w") < level if strict else F.col("w") <= level)
    lab = components(near)
    return nodes.select("id").join(lab.withColumnRenamed("id", "k"), F.col("id") == F.col("k"), "left").select("id", F.coalesce("label", "id").alias("label"))


def _placed(edges: DataFrame, levels: list[int]) -> DataFrame:
    """``u, v, w`` with ``w`` as the place of the first of the sorted ``levels`` that the edge belongs to; edges above all are left out."""
    at = reduce(Column.__add__, [(F.col("w") > d).cast("int") for d in levels])
    return edges.select("u", "v", at.alias("w")).where(F.col("w") < len(levels))


def hierarchy(edges: DataFrame, nodes: DataFrame, levels: list[int], block_edges: int = 200_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, level, cluster`` at each level, smallest member as name; columns of ``nodes`` to ``keep`` go before.

    A cluster is named anew only at levels where it joins one with a smaller
    member, so one tree of such joins holds all levels; a row per level is written
    out at the end only.
    """
    levels = sorted(set(levels))
    steps = level_paths(level_tree(_placed(edges, levels), block_edges)).select(F.col("id").alias("k"), "steps")
    return unfold(nodes.select(*keep, "id").join(steps, F.col("id") == F.col("k"), "left"), levels, keep)


def named_levels(edges: DataFrame, nodes: DataFrame, levels: list[int], block_edges: int = 600_000) -> DataFrame:
    """``id, labels``: ``hierarchy`` with one row for each node, its cluster at each of the sorted ``levels`` in order; pinned."""
    levels = sorted(set(levels))
    tree = level_tree(_placed(edges, levels), block_edges)
    paths = level_paths(tree)
    unpin(tree)
    named = pin(nodes.select("id").join(paths.select(F.col("id").alias("k"), "steps"), F.col("id") == F.col("k"), "left").select("id", _labels(len(levels)).alias("labels")), "named")
    unpin(paths)
    return named


def _labels(n: int) -> Column:
    """The cluster at each of ``n`` places of levels, in order, from ``id, steps``."""
    at = lambda p: F.coalesce(F.try_element_at(F.filter("steps", lambda x: x.w <= p), F.lit(-1)).label, F.col("id").cast("long"))
    return F.transform(F.array(*[F.lit(float(p)) for p in range(n)]), at)


def size_sums(edges: DataFrame, nodes: DataFrame, levels: list[int], block_edges: int = 600_000) -> tuple[int, list[float]]:
    """``(n, sums)``: the number of nodes, and for each of the sorted ``levels`` the sum of c ln c over the sizes c of the clusters of ``hierarchy``.

    No member is named. A vertex of the tree of joins from which none hangs is the
    whole of its clusters below the level at which it is joined, and is counted with
    the vertex above from there on; so leaves are taken off, again as long as many
    are. What is left is one block, or, if it is long chains, is named.
    """
    levels = sorted(set(levels))
    places = range(len(levels))
    tree = level_tree(_placed(edges, levels), block_edges)
    typed = lambda c, kind, name: (F.lit(None) if c is None else F.col(c)).cast(kind).alias(name)
    row = lambda x, up=None, w=None, kids=0: [typed(x, "long", "id"), typed(up, "long", "up"), typed(w, "int", "w"), F.lit(kids).alias("kids")]
    number = lambda x, name: F.lit(x).cast("long").alias(name)
    every = tree.select(*row("id", "up", "w"), number(0, "n")).unionByName(tree.select(*row("up", kids=1), number(0, "n"))).unionByName(nodes.select(*row("id"), number(1, "n")))
    own = [F.max(c).alias(c) for c in ("up", "w", "kids")]
    counted = pin(every.groupBy("id").agg(*own, F.sum("n").alias("n")), "sizes")
    unpin(tree)
    c = [f"c{p}" for p in places]
    log = lambda x, when: F.coalesce(F.sum(F.when(when & (F.col(x) > 0), F.col(x) * F.log(F.col(x).cast("double")))), F.lit(0.0))
    alone, leaf = F.expr("kids = 0 and up is null"), F.expr("kids = 0 and up is not null")
    n, single = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), log("n", alone)).first()
    sums = np.full(len(levels), single)
    now = renamed(counted.where(~alone).select("id", "up", "w", "kids", *[F.col("n").alias(x) for x in c]), counted)
    while True:
        left, leaves = now.agg(F.count("*"), F.count(F.when(leaf, 1))).first()
        if left <= block_edges or leaves < left / 5:
            break
        sums += np.array(now.agg(*[log(x, leaf & (F.col("w") > p)) for p, x in enumerate(c)]).first())
        inner = now.where("kids = 1")
        moved = now.where(leaf).select(*row("up"), *[F.when(F.col("w") <= p, F.col(x)).otherwise(0).alias(x) for p, x in enumerate(c)])
        folded = inner.select(*row("id", "up", "w"), *c).unionByName(inner.where("up is not null").select(*row("up", kids=1), *[number(0, x) for x in c])).unionByName(moved)
        new = pin(folded.groupBy("id").agg(*own, *[F.sum(x).alias(x) for x in c]), "sizes")
        unpin(now)
        sums += np.array(new.agg(*[log(x, alone) for x in c]).first())
        now = renamed(new.where(~alone), new)
    if left <= block_edges:
        rest = now.select("id", "up", "w", *c).coalesce(1).mapInArrow(_block_sums(len(levels)), "p int, s double")
    else:
        paths = level_paths(now.where("up is not null").select("id", "up", F.col("w").cast("double").alias("w")))
        named = now.join(paths.select("id", "steps"), "id", "left").select(F.posexplode(F.arrays_zip(_labels(len(levels)).alias("label"), F.array(*c).alias("c"))).alias("p", "x"))
        rest = named.groupBy("p", "x.label").agg(F.sum("x.c").alias("c")).groupBy("p").agg(log("c", F.lit(True)).alias("s"))
    for p, s in rest.collect():  # at most one row per level
        sums[p] += s
    unpin(now)
    return n, sums.tolist()


def _block_sums(n: int):
    """``p, s`` for each of ``n`` places of levels from the rows of whole trees, ``id, up, w`` and the nodes counted with a vertex at each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        ids = t["id"].to_numpy()
        order = np.argsort(ids)
        has = t["up"].is_valid().to_numpy()
        above = np.arange(len(ids))
        above[has] = order[np.searchsorted(ids[order], t["up"].drop_null().to_numpy())]
        since = np.full(len(ids), n)
        since[has] = t["w"].drop_null().to_numpy()
        sums = []
        for p in range(n):
            name = np.where(since <= p, above, np.arange(len(ids)))
            while not np.array_equal(further := name[name], name):
                name = further
            size = np.bincount(name, t[f"c{p}"].to_numpy())
            size = size[size > 0]
            sums.append(float(size @ np.log(size)))
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(sums, pa.float64())], ["p", "s"])

    return run


def unfold(named: DataFrame, levels: list[int], keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep, id, level, cluster`` at each level from ``id, steps``, whose ``w`` are places of ``levels``; without steps a cluster of its own."""
    steps = F.coalesce("steps", F.array().cast("array<struct<w:double,label:bigint>>"))
    held = named.select(*keep, "id", steps.alias("steps")).select(*keep, "id", F.col("steps.w").cast("array<int>").alias("w"), F.col("steps.label").alias("label"))
    zipped = F.arrays_zip(F.concat(F.array(F.lit(0)), "w").alias("since"), F.concat("w", F.array(F.lit(len(levels)))).alias("until"), F.concat(F.array(F.col("id").cast("long")), "label").alias("cluster"))
    spans = held.select(*keep, "id", F.inline(zipped)).where("since < until")
    every = F.array(*[F.lit(d).cast("int") for d in levels])
    return spans.select(*keep, "id", F.explode(F.slice(every, F.col("since") + 1, F.col("until") - F.col("since"))).alias("level"), "cluster")


def group_counts(edges: DataFrame, nodes: DataFrame, levels: list[int], block_edges: int = 200_000) -> DataFrame:
    """``level, n_groups``: clusters of the nodes at each level; no rows without nodes.

    Each vertex of the tree of joins but the least of a component is the name of a
    cluster up to its level, so the joins are counted and no member is named. Where
    edges reach samples that are no nodes, clusters of those alone must not count,
    and the members are named after all.
    """
    levels = sorted(set(levels))
    tree = level_tree(_placed(edges, levels), block_edges)
    ids = nodes.select("id").where("id is not null").distinct()
    ends = tree.select(F.explode(F.array("id", "up")).alias("id"))
    if not ends.join(ids, "id", "left_anti").isEmpty():
        unpin(tree)
        return hierarchy(edges, nodes, levels, block_edges).groupBy("level").agg(F.count_distinct("cluster").alias("n_groups"))
    joins = dict(tree.groupBy(F.col("w").cast("int")).agg(F.count("*")).collect())  # at most one row per level
    unpin(tree)
    n, rows, counts = ids.count(), not nodes.isEmpty(), []
    for at, level in enumerate(levels):
        n -= joins.get(at, 0)
        counts.append((level, n))
    return nodes.sparkSession.createDataFrame(counts if rows else [], "level int, n_groups bigint")


def collapse_curve(forest: DataFrame, n_nodes: int) -> DataFrame:
    """``w, n_clusters``: clusters left when edges shorter than each forest weight are joined."""
    by = forest.groupBy("w").agg(F.count("*").alias("c"))  # one row per distinct weight
    w = Window.orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    return by.select("w", (F.lit(n_nodes) - F.coalesce(F.sum("c").over(w), F.lit(0))).alias("n_clusters"))


def collapse_threshold(curve: DataFrame, target: int) -> DataFrame:
    """The weight whose cluster count is closest to ``target``, scanning upwards until the count is at most it; one row."""
    w = Window.orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    seen = curve.withColumn("least_before", F.min("n_clusters").over(w)).where(F.col("least_before").isNull() | (F.col("least_before") > target))
    return seen.agg(F.min_by(F.struct("w", "n_clusters"), F.struct(F.abs(F.col("n_clusters") - target), F.col("w"))).alias("b")).select(F.col("b.w").alias("threshold"), F.col("b.n_clusters").alias("n_clusters"))


def collapse(edges: DataFrame, nodes: DataFrame, target: int) -> DataFrame:
    """``id, rep, threshold, n``: every member of the about ``target`` clusters left by joining the edges under the chosen threshold.

    The smallest member represents a cluster; one row a member, so no cluster has to fit into a list.
    """
    at = pin(collapse_threshold(collapse_curve(spanning_forest(edges), nodes.count()), target).select("threshold"), "threshold")  # one row
    near = edges.crossJoin(F.broadcast(at)).where("w < threshold")
    lab = pin(labels_at(near.select("u", "v", "w"), nodes, float("inf")), "labels")
    size = lab.groupBy("label").agg(F.count("*").alias("n"))
    return lab.join(size, "label").crossJoin(F.broadcast(at)).select("id", F.col("label").alias("rep"), "threshold", "n")


def top_jumps(heights: DataFrame, n: int = 5) -> DataFrame:
    """The heights before the ``n`` largest jumps of a sorted distinct series ``h``."""
    w = Window.orderBy("h")
    jumps = heights.select("h").distinct().withColumn("jump", F.lead("h").over(w) - F.col("h")).where("jump is not null")
    return jumps.orderBy(F.desc("jump"), F.desc("h")).limit(n)


def dbscan(edges: DataFrame, nodes: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """``id, label, role``: density clusters of a pair table; -1 is noise.

    Core: at least ``min_samples`` samples within ``eps``, itself included.
    Clusters are components of core-core edges, numbered from 0 by their smallest
    core; a border sample takes the lowest-numbered neighbouring cluster.
    """
    near = pin(symmetrised(edges.where(F.col("w") <= eps)).select("i", "j"), "near")
    core = near.groupBy("i").agg((F.count("*") + 1).alias("n")).where(F.col("n") >= min_samples).select(F.col("i").alias("c"))
    if min_samples <= 1:
        core = nodes.select(F.col("id").alias("c"))
    core = pin(core, "core")
    cc = near.join(core, F.col("i") == F.col("c"), "left_semi").join(core, F.col("j") == F.col("c"), "left_semi")
    lab = components(cc.where("i < j").select(F.col("i").alias("u"), F.col("j").alias("v")))
    cores = core.join(lab, F.col("c") == F.col("id"), "left").select(F.col("c").alias("id"), F.coalesce("label", "c").alias("root"))
    roots = cores.select("root").distinct().withColumn("one", F.lit(0))
    number = number_within_key(roots, "one", ["root"]).select("root", F.col("_n").alias("label"))
    cores = pin(cores.join(number, "root").select("id", "label"), "cores")
    border = near.join(core, F.col("i") == F.col("c"), "left_anti").join(cores.withColumnRenamed("id", "j"), "j").groupBy("i").agg(F.min("label").alias("b"))
    out = nodes.select("id").join(cores, "id", "left").join(border, F.col("id") == F.col("i"), "left")
    role: Column = F.when(F.col("label").isNotNull(), "core").when(F.col("b").isNotNull(), "border").otherwise("noise")
    return out.select("id", F.coalesce("label", "b", F.lit(-1)).cast("int").alias("label"), role.alias("role"))


def eps_candidates(edges: DataFrame, n: int = 20) -> DataFrame:
    """``k, eps``: ``n`` evenly spaced values between the 10th and 90th percentile of the distances."""
    p = edges.agg(F.percentile("w", F.array(F.lit(0.1), F.lit(0.9))).alias("p"))
    return p.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(F.col("p")[0] + (F.col("p")[1] - F.col("p")[0]) * i / (n - 1), 6))).alias("k", "eps"))


def dbscan_each(edges: DataFrame, nodes: DataFrame, radii: DataFrame, min_samples: int) -> DataFrame:
    """``k, id, label`` for every radius (k, eps) in the same rounds: the smallest core names a cluster, -1 is noise.

    ``radii`` is a short list; ``min_samples`` is 2 at least. A sample that is core
    at one radius is so at all larger ones, and so is a link of two cores: the
    radii are the levels of one hierarchy, whose links start where both ends are core.
    """
    rows = [(r["k"], r["eps"]) for r in radii.collect()]
    steps = sorted({e for _, e in rows if e is not None})
    every = nodes.select("id", F.explode(F.array(*[F.lit(k).cast("long") for k, _ in rows])).alias("k"))
    if not steps:
        return every.select("k", "id", F.lit(-1).cast("long").alias("label"))
    near = pin(_placed(edges, steps), "near")
    both = symmetrised(near)
    nth = both.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("w"))).where(F.col("r") == max(2, min_samples) - 1)
    core = pin(nth.select(F.col("i").alias("id"), F.col("w").alias("core")), "core")  # from which radius on
    end = lambda c, n: core.select(F.col("id").alias(c), F.col("core").alias(n))
    links = near.join(end("u", "cu"), "u").join(end("v", "cv"), "v").select("u", "v", F.greatest("w", "cu", "cv").alias("w"))
    tree = level_tree(links)
    named = core.join(level_paths(tree).select("id", "steps"), "id", "left")
    at = unfold(named, list(range(len(steps)))).withColumnsRenamed({"level": "at", "cluster": "root"})
    cores = pin(at.join(core, "id").where("at >= core").select("at", "id", "root"), "cores")
    unpin(tree)
    edge = both.join(end("j", "cj"), "j").join(end("i", "ci"), "i", "left").select("i", "j", F.greatest("w", "cj").alias("lo"), F.coalesce(F.col("ci"), F.lit(len(steps))).alias("hi")).where("lo < hi")
    edge = edge.select("i", F.col("j").alias("id"), F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("at"))
    border = edge.join(cores, ["at", "id"]).groupBy("at", "i").agg(F.min("root").alias("root")).select("at", F.col("i").alias("id"), "root")
    own = F.element_at(F.create_map(*[F.lit(x) for i, e in enumerate(steps) for x in (i, [k for k, f in rows if f == e])]), F.col("at"))
    found = cores.unionByName(border).select(F.explode(own).alias("k"), "id", "root").withColumn("k", F.col("k").cast("long"))
    return every.join(found, ["k", "id"], "left").select("k", "id", F.coalesce("root", F.lit(-1).cast("long")).alias("label"))


def eps_choice(edges: DataFrame, nodes: DataFrame, min_samples: int = 5, n: int = 20) -> DataFrame:
    """One row ``eps, silhouette``: the candidate radius with the best mean silhouette, the smallest of equals.

    Candidates that give fewer than two clusters or leave more than half of the
    samples as noise are out; noise counts as a cluster of its own in the
    silhouette. If none is left: the median distance, and a null silhouette.
    """
    edges = pin(edges, "edges")
    radii = pin(eps_candidates(edges, n), "radii")
    lab = pin(dbscan_each(edges, nodes, radii, min_samples), "labels")
    kept = lab.groupBy("k").agg(F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("clusters"), F.avg((F.col("label") == -1).cast("double")).alias("noise")).where("clusters >= 2 and noise <= 0.5").select("k")
    sil = silhouettes(symmetrised(edges), lab.join(kept, "k"), ("k",)).groupBy("k").agg(F.round(F.avg("s"), 6).alias("silhouette"))
    best = sil.join(radii, "k").agg(F.min_by(F.struct("eps", "silhouette"), F.struct((-F.col("silhouette")).alias("s"), "k")).alias("b"))
    middle = edges.agg(F.percentile("w", F.lit(0.5)).alias("middle"))
    return best.crossJoin(F.broadcast(middle)).select(F.coalesce("b.eps", "middle").alias("eps"), F.col("b.silhouette").alias("silhouette"))  # one row


def eps_knee(edges: DataFrame) -> DataFrame:
    """One row ``knee_idx, eps``: the mean distance before the largest gap of the samples' sorted mean distances, the first of equals."""
    mean = symmetrised(edges).groupBy("i").agg(F.round(F.sum("w") / (F.count("*") + 1.0), 6).alias("m"))
    placed = pin(number_within_key(mean.withColumn("one", F.lit(0)), "one", ["m", "i"]).select("_n", "m"), "means")
    gap = placed.join(placed.select((F.col("_n") - 1).alias("_n"), F.col("m").alias("next")), "_n").select("_n", "m", F.round(F.col("next") - F.col("m"), 6).alias("gap"))
    return gap.agg(F.min_by(F.struct("_n", "m"), F.struct((-F.col("gap")).alias("g"), "_n")).alias("b")).select(F.col("b._n").alias("knee_idx"), F.col("b.m").alias("eps"))


def attach_parents(dist: DataFrame, rank: DataFrame) -> DataFrame:
    """``id, parent, d1``: for each sample the earlier one (in processing order) with least query-side distance, first on ties."""
    r = rank.select("id", "rank")
    d = dist.where("d1 >= 0 and i <> j").select("i", "j", "d1").distinct()
    d = d.join(r.withColumnsRenamed({"id": "i", "rank": "ri"}), "i").join(r.withColumnsRenamed({"id": "j", "rank": "rj"}), "j").where("rj < ri")
    return d.groupBy(F.col("i").alias("id")).agg(F.min_by(F.struct("j", "d1"), F.struct("d1", "rj")).alias("b")).select("id", F.col("b.j").alias("parent"), F.col("b.d1").alias("d1"))
