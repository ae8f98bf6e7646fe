"""Lists of rare alleles are taken in turns, and what a write shuffled does not stay on disk."""

import glob
import random

import numpy as np
from pyspark.sql import functions as F

from locuslake.operators import distance, graph, pairs
from locuslake.session import pin


def profiles(n, seed):
    r = random.Random(seed)
    out = []
    while len(out) < n:
        base = [r.randint(1, 60) for _ in range(64)]
        for _ in range(r.choice([1, 4, 60])):  # the largest families have more near pairs than a list of pairs holds
            p = [x if r.random() > 0.03 else r.choice([r.randint(1, 60), 320_000]) for x in base]
            out.append([0 if r.random() < 0.03 else x for x in p])
    return [*out[: n - 3], [0] * 64, [0] * 62 + [5, 0], [0] * 61 + [7, 5, 0]]


def links(a, within):
    """The clusters of all pairs by hand, at each level."""
    d, out = distance.block_d0(a, a), {}
    for level in range(within + 1):
        label = np.arange(len(a))
        while True:
            least = np.where(d <= level, label[None, :], len(a)).min(1)
            least = np.minimum(least, label)
            if (least == label).all():
                break
            label = least
        out |= {(level, i): int(x) for i, x in enumerate(label)}
    return out


def test_turns_and_tiles_give_the_levels_of_all_pairs(spark, monkeypatch):
    p = profiles(240, 3)
    df = spark.createDataFrame(list(enumerate(p)), "rep long, alleles array<int>")
    turns, real = [], pairs.pin
    monkeypatch.setattr(pairs, "pin", lambda t, what="t": [turns.append(what), real(t, what)][1])
    want = links(np.array(p, np.int32), 7)
    for chunk, rows in ((8, 500), (64, 300), (4096, None)):
        turns.clear()
        e = pairs.linking_edges(df, 7, chunk=chunk, turn_rows=rows)
        assert (turns.count("edges") > 4) == bool(rows)
        for level in (0, 2, 5, 7):
            got = {r.id: r.label for r in graph.components(e.where(F.col("w") <= level)).collect()}
            assert all(got.get(i, i) == want[level, i] for i in range(len(p)))


def test_a_matrix_gives_its_spanning_forest():
    r = np.random.default_rng(1)
    d = np.where(r.random((40, 40)) < 0.06, r.integers(0, 8, (40, 40)), 255).astype(np.uint8)
    d = np.minimum(d, d.T)
    np.fill_diagonal(d, 255)
    u, v = np.nonzero(np.triu(d < 255))
    kept = graph.kruskal(u, v, d[u, v])
    assert sorted(pairs._tree(d)[2].tolist()) == sorted(d[u, v][kept].tolist())


def test_a_pinned_table_leaves_no_shuffle_files(spark):
    files = lambda: set(glob.glob(spark.sparkContext.getConf().get("spark.local.dir") + "/**/shuffle_*", recursive=True))
    before = files()
    pin(spark.range(5000).repartition(4).groupBy((F.col("id") % 900).alias("k")).agg(F.count("*").alias("n")))
    assert not files() - before


def test_rows_of_levels_are_written_after_the_last_join(spark):
    df = spark.createDataFrame(list(enumerate(profiles(60, 5))), "sample_idx long, alleles array<int>")
    plan = pairs.profile_hierarchy(df, list(range(8)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and plan.index("Generate") < plan.index("Join")
