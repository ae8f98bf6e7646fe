"""Graphs over samples: edges, nearest neighbours, components, spanning forests, islands, tree layouts."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin, unpin
from .hotkeys import number_within_key


def valid_rows(dist: DataFrame, w: str = "d0") -> DataFrame:
    """Undirected ``u < v, w`` as often as listed, enough for levels; null, negative, NaN and self pairs dropped."""
    d = F.col(w).cast("double")
    ok = dist.where(F.col("i").isNotNull() & F.col("j").isNotNull() & (F.col("i") != F.col("j")) & (d >= 0) & ~F.isnan(d) & (d < float("inf")))
    return ok.select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), F.col(w).alias("w"))


def valid_edges(dist: DataFrame, w: str = "d0") -> DataFrame:
    """``valid_rows`` with each pair once, at its least distance."""
    return valid_rows(dist, w).groupBy("u", "v").agg(F.min("w").alias("w"))


def symmetrised(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: ``i, j, w``."""
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("i"), F.col("v").alias("j"), "w"), F.struct(F.col("v").alias("i"), F.col("u").alias("j"), "w"))).alias("e")).select("e.*")


def knn_edges(edges: DataFrame, k: int) -> DataFrame:
    """Undirected edges that are among the ``k`` nearest of either end (ties by neighbour)."""
    near = symmetrised(edges).withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("w", "j"))).where(F.col("r") <= k)
    return near.select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), "w").distinct()


def _blocks(df: DataFrame, solve, schema: str, rows: int) -> DataFrame:
    """``solve`` on blocks of about ``rows`` rows of each partition, as they come: no shuffle, bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                held.append(batch.slice(start, rows))
                n += held[-1].num_rows
                if n >= rows:
                    yield from solve(pa.Table.from_batches(held)).to_batches()
                    held, n = [], 0
        if n:
            yield from solve(pa.Table.from_batches(held)).to_batches()

    return df.mapInArrow(run, schema)


def level_tree(edges: DataFrame, block_edges: int = 200_000, max_rounds: int = 1000, by: str | None = None, named: bool = False) -> DataFrame:
    """``id, up, w``: for each vertex but the least of its component the lowest ``w`` at which it is joined to a smaller one, and such a one; pinned.

    The edges (id, up, w) connect the same vertices as ``edges`` at every level.
    With ``named`` each row also has ``u, v``, the edge of the input it stands for:
    together they are the minimum spanning forest under (w, u, v). One solution per
    value of ``by`` if given.

    In a block of edges, taken in order, two clusters that meet are joined by an
    edge between their least members and an edge inside a cluster is dropped, so a
    vertex keeps one edge to a smaller one and passes the others down. Where weights
    are few, all clusters that meet at one are joined at once to the smallest. Blocks are
    ranges of the larger end: the topmost range is settled after one round, the
    next after two, so the rounds are bounded by the blocks; since edges passed down
    gather at few small vertices, they are far fewer in practice. Whether all are
    settled is looked up once a round leaves nearly as many rows as it found.
    """
    k = ["k"] if by else []
    own = ["u", "v"] if named else []
    order = ["v", "u", "w"] if named else ["b", "a", "w"]

    def join(t: pa.Table) -> pa.Table:
        c = {n: t[n].to_numpy() for n in t.column_names}
        rows, flat = _flat(c["a"], c["b"], c.get("k"))
        ids = rows[:, -1] if by else rows
        a, b = flat[: len(c["a"])], flat[len(c["a"]) :]
        at = np.argsort(c["w"], kind="stable")
        since = np.flatnonzero(np.diff(c["w"][at])) + 1
        if not named and len(since) < len(at) / 100:
            high, low, w = _stars(a, b, c["w"], np.split(at, since), len(rows))
            return pa.table({"k": rows[high, 0]} | {"a": ids[high], "b": ids[low], "w": w} if by else {"a": ids[high], "b": ids[low], "w": w})
        keep, high, low = _joins(a, b, np.lexsort([c[n] for n in order]), len(rows))
        out = {n: c[n][keep] for n in [*k, "w", *own]} | {"a": ids[high], "b": ids[low]}
        return pa.table({n: out[n] for n in [*k, "a", "b", "w", *own]})

    schema = ", ".join([*[f"{n} bigint" for n in [*k, "a", "b"]], "w double", *[f"{n} bigint" for n in own]])
    long = lambda c, n: F.col(c).cast("long").alias(n)
    ends = [F.greatest("u", "v").cast("long").alias("a"), F.least("u", "v").cast("long").alias("b")]
    now = pin(edges.where("u <> v").select(*[long(by, "k") for _ in k], *ends, F.col("w").cast("double").alias("w"), *[long(c, c) for c in own]), "edges")
    n = now.count()
    cores, slow = edges.sparkSession.sparkContext.defaultParallelism, False
    for r in range(max_rounds):
        parts, before = -(-n // block_edges), n
        whole = parts <= 1
        if parts > cores:
            parts = cores * max(1, round(n / block_edges / cores))  # tasks of equal length keep all cores busy to the end
        placed = now.coalesce(1) if whole else now.repartitionByRange(parts, *k, "a")
        if slow:
            placed = placed.sortWithinPartitions(*k, "a")  # a partition that is cut into blocks is cut between vertices
        # blocks differ from round to round, so that the rows of a vertex come to lie in one
        new = pin(_blocks(placed, join, schema, 2 * block_edges + 997 * r), "tree")
        unpin(now)
        now, n = new, new.count()
        slow = n > 0.98 * before
        if whole or slow and now.groupBy(*k, "a").count().where("count > 1").isEmpty():
            return renamed(now.select(*[F.col("k").alias(by) for _ in k], F.col("a").alias("id"), F.col("b").alias("up"), "w", *own), now)
    raise RuntimeError(f"not settled after {max_rounds} rounds")


def renamed(df: DataFrame, pinned: DataFrame) -> DataFrame:
    """``df``, columns or rows of a pinned table, which ``unpin`` can delete by it."""
    df._pinned_at = pinned._pinned_at
    return df


def _flat(u: np.ndarray, v: np.ndarray, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, places)``: the distinct ends in order, with their key if given, and the place of each of ``u`` and then ``v``."""
    ends = np.concatenate([u, v])
    if key is None:
        return np.unique(ends, return_inverse=True)
    keys = np.concatenate([key, key])
    at = np.lexsort((ends, keys))
    new = np.concatenate([[True], (np.diff(ends[at]) != 0) | (np.diff(keys[at]) != 0)])[: len(at)]
    flat = np.empty(len(at), np.int64)
    flat[at] = np.cumsum(new) - 1
    first = at[new]
    return np.stack([keys[first], ends[first]], 1), flat


def _joins(u: np.ndarray, v: np.ndarray, order: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(edges, high, low)``: the edges that join two clusters, in order, and the least members of the two; vertices are 0 to n - 1."""
    parent = list(range(n))
    keep, high, low = array("q"), array("q"), array("q")
    for s in range(0, len(order), 65_536):
        at = order[s : s + 65_536]
        for e, x, y in zip(at.tolist(), u[at].tolist(), v[at].tolist(), strict=True):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            while parent[y] != y:
                parent[y] = parent[parent[y]]
                y = parent[y]
            if x != y:
                if x < y:
                    x, y = y, x
                parent[x] = y
                keep.append(e)
                high.append(x)
                low.append(y)
    return np.array(keep, np.int64), np.array(high, np.int64), np.array(low, np.int64)


def _stars(u: np.ndarray, v: np.ndarray, w: np.ndarray, levels: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(high, low, w)``: at each level, given by its edges in order, the least members of the clusters that are joined there to one with a smaller member, and the smallest; vertices are 0 to n - 1."""
    up, label = np.arange(n), np.arange(n)
    found = []
    for at in levels:
        x, y = label[u[at]], label[v[at]]
        hung = []
        while (apart := x != y).any():
            x, y = x[apart], y[apart]
            high = np.maximum(x, y)
            np.minimum.at(up, high, np.minimum(x, y))
            hung.append(np.unique(high))
            _shorten(up, hung[-1])
            x, y = up[x], up[y]
        if hung:
            high = np.concatenate(hung)
            _shorten(up, high)
            found.append((high, up[high], np.full(len(high), w[at[0]])))
            label = up[label]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.array([], np.int64), np.array([], np.int64), np.array([], float))


def _shorten(up: np.ndarray, at: np.ndarray) -> None:
    """Lets the vertices ``at`` hang from the tops of their paths, all of which lie in ``at`` but the top."""
    while not np.array_equal(further := up[up[at]], up[at]):
        up[at] = further


def level_paths(tree: DataFrame, by: str | None = None, max_rounds: int = 60) -> DataFrame:
    """``id, root, steps`` from ``level_tree``: the smallest of the component, and (w, label) for each level at which the vertex's cluster is renamed; pinned.

    ``label`` is the least member of the cluster from ``w`` on; ``steps`` rise in
    both and have at most as many entries as there are levels. Each round doubles
    the length of the paths that are done.
    """
    on = [by] if by else []
    now = pin(tree.select(*on, "id", F.col("up").alias("root"), F.array(F.struct("w", F.col("up").alias("label"))).alias("steps"), F.lit(True).alias("on")), "paths")
    last = F.element_at("steps", -1)
    # what comes above at the same level or a lower one renames the last step, the rest follows it
    same = F.filter("more", lambda x: x.w <= F.element_at("steps", -1).w)
    tail = F.filter("more", lambda x: x.w > F.element_at("steps", -1).w)
    middle = F.struct(last.w.alias("w"), F.coalesce(F.try_element_at(same, F.lit(-1)).label, last.label).alias("label"))
    joined = F.concat(F.slice("steps", F.lit(1), F.size("steps") - 1), F.array(middle), tail)
    for _ in range(max_rounds):
        if now.where("on").isEmpty():
            return renamed(now.select(*on, "id", "root", "steps"), now)
        above = now.select(*on, F.col("id").alias("root"), F.col("root").alias("far"), F.col("steps").alias("more"))
        hop = now.where("on").join(above, [*on, "root"], "left").select(*on, "id", F.coalesce("far", "root").alias("root"), F.when(F.col("far").isNull(), F.col("steps")).otherwise(joined).alias("steps"), F.col("far").isNotNull().alias("on"))
        new = pin(now.where("not on").unionByName(hop), "paths")
        unpin(now)
        now = new
    raise RuntimeError(f"paths not done after {max_rounds} rounds")


def components(edges: DataFrame, block_edges: int = 200_000, max_rounds: int = 60, by: str | None = None) -> DataFrame:
    """``id, label``: smallest id of the component, for every id with an edge; one solution per value of ``by`` if given.

    The levels of ``level_tree`` with one level; the rounds do not depend on the
    diameter.
    """
    tree = level_tree(edges.select(*([by] if by else []), "u", "v", F.lit(0.0).alias("w")), block_edges, by=by)
    found = level_paths(tree, by, max_rounds).select(*([by] if by else []), "id", F.col("root").alias("label"))
    unpin(tree)
    least = found.select(*([by] if by else []), F.col("label").alias("id"), "label").distinct()
    return found.unionByName(least)


def spanning_forest(edges: DataFrame, block_edges: int = 200_000, max_rounds: int = 1000) -> DataFrame:
    """Minimum spanning forest ``u, v, w`` under the total order (w, u, v), which makes it unique."""
    return level_tree(edges, block_edges, max_rounds, named=True).select("u", "v", "w")


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, labels)`` of a bounded block of edges."""
    ids, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(ids)))
    for x, y in zip(flat[: len(u)].tolist(), flat[len(u) :].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
    for x in range(len(parent)):
        parent[x] = parent[parent[x]]
    return ids, ids[np.array(parent, np.int64)] if len(ids) else ids


def kruskal(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Indices of the edges of the minimum spanning forest under (w, u, v)."""
    ids, flat = _flat(u, v)
    return _joins(flat[: len(u)], flat[len(u) :], np.lexsort((v, u, w)), len(ids))[0]


def joining_edges(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(u, v, w)``: fewest edges that connect the same vertices at every level, each from the least member of a cluster to that of one it joins."""
    ids, flat = _flat(u, v)
    keep, high, low = _joins(flat[: len(u)], flat[len(u) :], np.argsort(w, kind="stable"), len(ids))
    return ids[low], ids[high], w[keep]


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def island_stats(edges: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per component: size, inner edges, edges to other components, density (1 for singletons)."""
    lab = nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    e = edges.join(lab.select(F.col("id").alias("u"), F.col("label").alias("lu")), "u").join(lab.select(F.col("id").alias("v"), F.col("label").alias("lv")), "v")
    inner = e.where("lu = lv").groupBy(F.col("lu").alias("label")).agg(F.count("*").alias("inner_edges"))
    outer = e.where("lu <> lv").select(F.explode(F.array("lu", "lv")).alias("label")).groupBy("label").agg(F.count("*").alias("outer_edges"))
    size = lab.groupBy("label").agg(F.count("*").alias("size"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    out = size.join(inner, "label", "left").join(outer, "label", "left").select("label", "size", zero("inner_edges").alias("inner_edges"), zero("outer_edges").alias("outer_edges"))
    return out.withColumn("density", F.when(F.col("size") == 1, 1.0).otherwise(F.round(2.0 * F.col("inner_edges") / (F.col("size") * (F.col("size") - 1)), 6)))


def rooted_levels(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """``id, parent, root, depth``: each tree of a forest hung from its vertex of highest degree (smallest id on ties).

    Leaves hang from their only neighbour and are taken off first, again as long as
    many are. The arcs of what is left of a tree form one closed walk, cut at the
    root. Its arcs are ranked by pointer doubling, and an edge leads down in the
    direction walked first, so the rounds grow with the logarithm of the vertices
    and not with the depth.
    ``nodes`` without edges are roots of their own.
    """
    both = pin(symmetrised(edges).select("i", "j"), "both")
    deg = both.groupBy("i").agg(F.count("*").alias("degree"))
    comp = components(edges.select("u", "v"))
    root = deg.join(comp, F.col("i") == F.col("id")).groupBy("label").agg(F.min_by("i", F.struct((-F.col("degree")).alias("d"), "i")).alias("root"))
    root_of = pin(comp.join(root, "label").select("id", "root"), "roots")
    both, leaves = _without_leaves(both, root_of)
    around = Window.partitionBy("i")
    ring = both.withColumn("after", F.lead("j").over(around.orderBy("j"))).withColumn("first", F.min("j").over(around)).join(root_of, F.col("i") == F.col("id"))
    onward = F.coalesce("after", F.when(F.col("i") != F.col("root"), F.col("first")))  # null: the walk ends here
    now = pin(ring.select(F.col("j").alias("a"), F.col("i").alias("b"), F.when(onward.isNotNull(), F.col("i")).alias("na"), onward.alias("nb"), F.lit(1).cast("long").alias("left")), "walk")
    for _ in range(max_rounds):
        if now.where("na is not null").isEmpty():
            break
        ahead = now.select(F.col("a").alias("na"), F.col("b").alias("nb"), F.col("na").alias("na2"), F.col("nb").alias("nb2"), F.col("left").alias("more"))
        hop = now.where("na is not null").join(ahead, ["na", "nb"]).select("a", "b", F.col("na2").alias("na"), F.col("nb2").alias("nb"), (F.col("left") + F.col("more")).alias("left"))
        new = pin(now.where("na is null").unionByName(hop), "walk")
        unpin(now)
        now = new
    else:
        raise RuntimeError(f"walk not ranked after {max_rounds} rounds")
    down = now.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.max_by(F.struct("a", "b"), "left").alias("e")).select(F.col("e.b").alias("id"), F.col("e.a").alias("parent"))
    for leaf in leaves:
        down = down.unionByName(leaf)
    tree = root_of.join(down, "id", "left").select("id", "parent", "root")
    if nodes is not None:
        lone = nodes.select("id").distinct().join(root_of.select("id"), "id", "left_anti")
        tree = tree.unionByName(lone.select("id", F.lit(None).cast("long").alias("parent"), F.col("id").alias("root")))
    tree = pin(tree, "tree")
    depth = _from_root(tree.withColumns({"share": F.lit(1.0), "shift": F.when(F.col("parent").isNull(), 0.0).otherwise(1.0)}), max_rounds)
    return tree.join(depth.select("id", F.col("shift").cast("int").alias("depth")), "id").select("id", "parent", "root", "depth")


def _without_leaves(both: DataFrame, root_of: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The arcs ``i, j`` between what is left after leaves (not roots) are taken off, and ``id, parent`` of those taken off; pinned.

    Goes on while at least a fifth of the arcs goes: a round costs less than the rounds of the walk that these would take part in.
    """
    leaves, rows = [], both.count()
    while rows:
        ends = both.groupBy("i").agg(F.count("*").alias("degree"), F.min("j").alias("parent")).where("degree = 1").withColumnRenamed("i", "id")
        leaf = pin(ends.join(root_of, "id").where("id <> root").select("id", "parent"), "leaves")
        less = pin(both.join(leaf.select(F.col("id").alias("i")), "i", "left_anti").join(leaf.select(F.col("id").alias("j")), "j", "left_anti").select("i", "j"), "both")
        unpin(both)
        leaves.append(leaf)
        both, before, rows = less, rows, less.count()
        if before - rows < before / 5:
            break
    return both, leaves


def _from_root(tree: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``id, share, shift`` against the root, from ``id, parent, share, shift`` against the parent.

    A vertex at ``shift`` s with ``share`` f of a parent's extent lies at (place +
    s * extent) and has the extent (f * extent). Such steps can be joined in any
    grouping, so each round doubles the length of the paths that are done.
    """
    now = pin(tree.select("id", F.col("parent").alias("up"), "share", "shift"), "paths")
    for _ in range(max_rounds):
        if now.where("up is not null").isEmpty():
            return now.select("id", "share", "shift")
        above = now.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("share").alias("f"), F.col("shift").alias("s"))
        hop = now.where("up is not null").join(above, "up").select("id", F.col("up2").alias("up"), (F.col("f") * F.col("share")).alias("share"), (F.col("s") + F.col("f") * F.col("shift")).alias("shift"))
        new = pin(now.where("up is null").unionByName(hop), "paths")
        unpin(now)
        now = new
    raise RuntimeError(f"paths not done after {max_rounds} rounds")


def _numbered(df: DataFrame, key: list[str]) -> DataFrame:
    """``df`` with ``rank``, the place by id among the rows of one key, and their number ``n``; a key of very many rows takes many tasks."""
    placed = number_within_key(df.withColumn("_key", F.xxhash64(*key)), "_key", [*key, "id"])
    n = placed.groupBy("_key").agg(F.count("*").alias("n"))
    return placed.join(n, "_key").withColumnRenamed("_n", "rank").drop("_key")


def _ranked(levels: DataFrame) -> DataFrame:
    """``levels`` with ``rank`` among the children of a parent (by id) and their number ``n``; roots are alone."""
    child = _numbered(levels.where("depth > 0"), ["parent"])
    return child.unionByName(levels.where("depth = 0").withColumns({"rank": F.lit(0).cast("long"), "n": F.lit(1).cast("long")}))


def _below(top, child):
    """``top`` at a root, ``child`` elsewhere."""
    return F.when(F.col("depth") == 0, top).otherwise(child)


def tree_layout(levels: DataFrame, width: float = 2.0) -> DataFrame:
    """``id, x, y``: children share their parent's width."""
    ranked = pin(_ranked(levels), "ranked")
    share = 1 / (F.col("n") + 1)
    at = _from_root(ranked.select("id", "parent", _below(F.lit(1.0), share).alias("share"), _below(F.lit(0.0), (F.col("rank") + 0.5) * share - 0.5).alias("shift")))
    return at.join(ranked.select("id", "depth"), "id").select("id", F.round(F.col("shift") * width, 6).alias("x"), (-F.col("depth")).cast("double").alias("y"))


def radial_layout(levels: DataFrame) -> DataFrame:
    """``id, x, y``: children share their parent's angle, one unit of radius per depth."""
    ranked = pin(_ranked(levels), "ranked")
    at = _from_root(ranked.select("id", "parent", _below(F.lit(1.0), 1 / F.col("n")).alias("share"), _below(F.lit(0.0), (F.col("rank") + 0.5) / F.col("n") - 0.5).alias("shift")))
    angle = F.col("shift") * (2 * np.pi)
    return at.join(ranked.select("id", "depth"), "id").select("id", F.round(F.col("depth") * F.cos(angle), 6).alias("x"), F.round(F.col("depth") * F.sin(angle), 6).alias("y"))


def hierarchical_layout(levels: DataFrame) -> DataFrame:
    """``id, x, y``: breadth-first levels, spread two units apart."""
    ranked = _numbered(levels, ["root", "depth"])
    return ranked.select("id", ((F.col("rank") - F.col("n") / 2.0) * 2).alias("x"), (-2.0 * F.col("depth")).alias("y"))
