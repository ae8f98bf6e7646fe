"""Levels stand on pairs as they are listed: no shuffle brings those listed twice together."""

from locuslake.operators import cluster, graph
from locuslake.plans import core_queries


def takes_pairs_as_listed(spark, sf, monkeypatch, name):
    def once(*_, **__):
        raise AssertionError("pairs are grouped")

    monkeypatch.setattr(graph, "valid_edges", once)
    assert core_queries.Q[name](spark, sf).collect()


def test_nmi_levels_takes_pairs_as_listed(spark, sf, monkeypatch):
    takes_pairs_as_listed(spark, sf, monkeypatch, "nmi_levels")


def test_nmi_heat_takes_pairs_as_listed(spark, sf, monkeypatch):
    takes_pairs_as_listed(spark, sf, monkeypatch, "nmi_heat")


def test_pairs_listed_twice_give_the_same_levels(spark):
    rows = [(1, 2, 5), (2, 1, 3), (1, 2, 3), (2, 3, 9), (3, 2, 4), (4, 4, 0), (4, 5, -1), (5, 4, None), (None, 5, 1), (6, 5, 7), (5, 6, 8), (6, 1, 20)]
    dist = spark.createDataFrame(rows, "i long, j long, d0 int")
    nodes = spark.createDataFrame([(x,) for x in range(1, 8)], "id long")
    labels = lambda e, **k: {x.id: list(x.labels) for x in cluster.named_levels(e, nodes, [0, 3, 4, 7, 30], **k).collect()}
    want = labels(graph.valid_edges(dist))
    assert want == {1: [1] * 5, 2: [2, 1, 1, 1, 1], 3: [3, 3, 1, 1, 1], 4: [4] * 5, 5: [5, 5, 5, 5, 1], 6: [6, 6, 6, 5, 1], 7: [7] * 5}
    assert labels(graph.valid_rows(dist)) == labels(graph.valid_rows(dist), block_edges=2) == want
