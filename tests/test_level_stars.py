"""Where weights are few, the clusters that meet at one are joined at once to the smallest, as one after the other would."""

import numpy as np

from locuslake.operators import graph


def labels(high, low, w, level, n):
    up = np.arange(n)
    up[high[w <= level]] = low[w <= level]
    while not np.array_equal(up[up], up):
        up = up[up]
    return up


def test_stars_equal_joins_one_by_one():
    r = np.random.default_rng(4)
    n = 3000
    p = r.permutation(n)
    shapes = [(r.integers(0, n, 4000), r.integers(0, n, 4000)), (np.arange(n - 1), np.arange(1, n)), (p[:-1], p[1:]), (np.full(n - 1, n - 1), np.arange(n - 1))]
    for u, v in shapes:
        w = r.integers(0, 7, len(u)).astype(float)
        at = np.argsort(w, kind="stable")
        high, low, since = graph._stars(u, v, w, np.split(at, np.flatnonzero(np.diff(w[at])) + 1), n)
        keep, h, b = graph._joins(u, v, at, n)
        assert len(np.unique(high)) == len(high) == len(keep) and (low < high).all()
        assert all(np.array_equal(labels(high, low, since, d, n), labels(h, b, w[keep], d, n)) for d in range(7))


def test_clusters_of_a_block_hang_from_the_smallest(spark):
    r = np.random.default_rng(5)
    p = [int(x) for x in r.permutation(400)]
    edges = spark.createDataFrame([(k, x, y, 3) for k in (1, 2) for x, y in zip(p, p[1:], strict=False)], "k long, u long, v long, w int")
    assert {(x.k, x.up, x.w) for x in graph.level_tree(edges, by="k").collect()} == {(1, 0, 3.0), (2, 0, 3.0)}
    one = edges.where("k = 1")
    assert sorted((x.id, x.up) for x in graph.level_tree(one).collect()) == [(x, 0) for x in range(1, 400)]
    assert sorted((x.id, x.label) for x in graph.components(one.select("u", "v"), block_edges=30).collect()) == [(x, 0) for x in range(400)]
