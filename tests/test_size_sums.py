"""Sums over the sizes of clusters stand on the tree of joins: no member is named, and they equal those of the named members."""

import math
import random
from collections import Counter

from locuslake.operators import cluster, evaluate
from locuslake.plans import core_queries

LEVELS = [0, 3, 7, 12]


def equal(spark, edges, nodes, block_edges):
    named = cluster.named_levels(edges, nodes, LEVELS)
    sizes = [Counter(r.labels[p] for r in named.collect()) for p in range(len(LEVELS))]
    n, sums = cluster.size_sums(edges, nodes, LEVELS, block_edges)
    assert n == nodes.count()
    assert all(abs(s - sum(c * math.log(c) for c in size.values())) < 1e-6 for s, size in zip(sums, sizes, strict=True))
    order = lambda df: sorted((r.level1, r.level2, r.nmi) for r in df.collect())
    assert order(evaluate.summed_information(spark, n, sums, LEVELS)) == order(evaluate.named_information(named, LEVELS))


def test_sums_of_families(spark):
    r = random.Random(8)
    rows = [(a := r.randint(0, 300), a // 10 * 10 + r.randint(0, 9), r.randint(0, 15)) for _ in range(500)] + [(1, 250, 12), (9, 9, 1)]
    edges = spark.createDataFrame([(min(u, v), max(u, v), w) for u, v, w in rows if u != v], "u long, v long, w int")
    nodes = spark.createDataFrame([(x,) for x in [*range(290), 3, 3, 500, 500, None, None]], "id long")  # some twice, without pairs, or not listed
    for block_edges in (20, 100, 10_000):
        equal(spark, edges, nodes, block_edges)


def test_sums_of_a_long_chain(spark):
    r = random.Random(9)
    edges = spark.createDataFrame([(x, x + 1, r.randint(0, 15)) for x in range(200)] + [(x, 1000 + x, 3) for x in range(0, 200, 2)], "u long, v long, w int")
    nodes = spark.createDataFrame([(x,) for x in [*range(201), *range(1000, 1200)]], "id long")
    for block_edges in (30, 10_000):
        equal(spark, edges, nodes, block_edges)


def test_no_nodes_no_levels(spark):
    edges = spark.createDataFrame([(1, 2, 3)], "u long, v long, w int")
    assert cluster.size_sums(edges, edges.select(edges.u.alias("id")).where("false"), LEVELS) == (0, [0.0] * 4)
    assert evaluate.summed_information(spark, 0, [0.0] * 4, LEVELS).collect() == []


def test_nmi_heat_names_no_member(spark, sf, monkeypatch):
    def named(*_, **__):
        raise AssertionError("members are named")

    monkeypatch.setattr(cluster, "level_paths", named)
    assert core_queries.Q["nmi_heat"](spark, sf).collect()
