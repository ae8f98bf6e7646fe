"""Levels named in one row a sample give what a row a level gives, and are found once for all that stands on them."""

import random

from pyspark.sql import functions as F

from locuslake.operators import cluster, evaluate, graph
from locuslake.plans import core_queries

LEVELS = [0, 3, 7, 12]


def tables(spark):
    r = random.Random(5)
    rows = {(min(a, b), max(a, b)): r.randint(0, 15) for a, b in ((r.randint(0, 40), r.randint(0, 40)) for _ in range(90)) if a != b}
    edges = spark.createDataFrame([(u, v, w) for (u, v), w in rows.items()], "u long, v long, w int")
    nodes = spark.createDataFrame([(x,) for x in [*range(36), 3, 3, 50, None]], "id long")  # some twice, without pairs, or not listed
    return edges, nodes


def test_named_levels_equal_rows_of_levels(spark):
    edges, nodes = tables(spark)
    every = F.arrays_zip(F.array(*[F.lit(d) for d in LEVELS]).alias("level"), F.col("labels").alias("cluster"))
    got = cluster.named_levels(edges, nodes, LEVELS).select("id", F.inline(every))
    order = lambda df: sorted((str(x.id), x.level, str(x.cluster)) for x in df.collect())
    assert order(got) == order(cluster.hierarchy(edges, nodes, LEVELS))


def test_means_and_information_equal_rows_of_levels(spark):
    edges, nodes = tables(spark)
    both, h = graph.symmetrised(edges), cluster.hierarchy(edges, nodes, LEVELS)
    named = cluster.named_levels(edges, nodes, LEVELS)
    want = {d: round(sum(x) / len(x), 6) for d in LEVELS for x in [[r.s for r in evaluate.silhouettes(both, h.where(f"level = {d}").withColumnRenamed("cluster", "label")).collect()]]}
    for size in ("1", "7", "10000"):  # samples that go on in the next batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = {r.level: r.silhouette for r in evaluate.silhouette_means(both, named, LEVELS).collect()}
        assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 2e-6 for d in LEVELS)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pairs = lambda df: sorted((r.level1, r.level2, r.nmi) for r in df.collect())
    assert pairs(evaluate.named_information(named, LEVELS)) == pairs(evaluate.nested_information(h))
    assert evaluate.silhouette_means(both, named.where("false"), LEVELS).collect() == []


def test_breakpoints_find_the_levels_once(spark, sf, monkeypatch):
    calls, real = [], cluster.level_tree
    monkeypatch.setattr(cluster, "level_tree", lambda *a, **k: calls.append(1) or real(*a, **k))
    core_queries.Q["breakpoint_levels"](spark, sf).collect()
    assert len(calls) == 1
