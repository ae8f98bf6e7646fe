import random

from locuslake.operators import cluster


def test_each_radius_as_if_alone(spark):
    r = random.Random(8)
    rows = {(min(a, b), max(a, b)): r.randint(0, 12) for a, b in ((r.randint(0, 40), r.randint(0, 40)) for _ in range(170)) if a != b}
    edges = spark.createDataFrame([(u, v, w) for (u, v), w in rows.items()], "u long, v long, w int")
    nodes = spark.range(43)
    radii = [(0, 2.0), (1, 4.5), (2, 4.5), (3, 9.0), (4, None)]
    got = {(x.k, x.id): x.label for x in cluster.dbscan_each(edges, nodes, spark.createDataFrame(radii, "k int, eps double"), 4).collect()}
    assert len(got) == 43 * len(radii)
    for k, eps in radii:
        near = {x: {y for (u, v), w in rows.items() if eps is not None and w <= eps and x in (u, v) for y in (u, v) if y != x} for x in range(43)}
        core = {x for x in near if len(near[x]) + 1 >= 4}
        label = {x: x for x in core}
        for _ in core:
            label = {x: min([label[x], *[label[y] for y in near[x] & core]]) for x in core}
        for x in range(43):
            want = label[x] if x in core else min([label[y] for y in near[x] & core], default=-1)
            assert got[k, x] == want


def test_radii_are_levels_of_one_tree(spark, monkeypatch):
    def each(*_, **__):
        raise AssertionError("every radius is solved for itself")

    monkeypatch.setattr(cluster, "components", each)
    edges = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (1, 2, 3)], "u long, v long, w int")
    got = {(x.k, x.id): x.label for x in cluster.dbscan_each(edges, spark.range(4), spark.createDataFrame([(0, 1.0), (1, 3.0)], "k int, eps double"), 3).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (0, 2): 0, (0, 3): -1, (1, 0): 0, (1, 1): 0, (1, 2): 0, (1, 3): -1}
