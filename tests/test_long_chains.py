"""Chains over many blocks whose small members lie far from their ends: rounds must not grow with the diameter."""

from functools import partial

from locuslake.operators import cluster, evaluate, graph, pairs
from locuslake.plans import core_queries

ARM = 80


def ids():
    """Ids along the chain: two valleys, the second one deeper."""
    valley = [2 * abs(x - ARM) + (x < ARM) for x in range(2 * ARM)]
    return [2 * x + 1 for x in valley] + [2 * x for x in valley]


def chain(spark):
    at = ids()
    return spark.createDataFrame([(a, b, 1 + k % 3) for k, (a, b) in enumerate(zip(at, at[1:]))], "u long, v long, w int").repartition(8)


def by_hand(level):
    label, at = {}, ids()
    start = 0
    for k in range(len(at)):
        if k + 1 == len(at) or 1 + k % 3 > level:
            label |= dict.fromkeys(at[start : k + 1], min(at[start : k + 1]))
            start = k + 1
    return label


def test_components_of_valleys(spark):
    assert {r.id: r.label for r in graph.components(chain(spark), block_edges=40).collect()} == dict.fromkeys(ids(), 0)


def test_hierarchy_of_valleys(spark):
    nodes = spark.createDataFrame([(x,) for x in [*ids(), 5000]], "id long")
    got = {(r.level, r.id): r.cluster for r in cluster.hierarchy(chain(spark), nodes, [0, 1, 2, 3, 9], block_edges=40).collect()}
    assert got == {(d, x): c for d in (0, 1, 2, 3, 9) for x, c in (by_hand(d) | {5000: 5000}).items()}


def test_group_counts_of_valleys(spark):
    nodes = spark.createDataFrame([(x,) for x in [*ids(), 5000, 5000, None]], "id long")
    got = {r.level: r.n_groups for r in cluster.group_counts(chain(spark), nodes, [0, 1, 2, 3, 9], block_edges=40).collect()}
    assert got == {d: len(set(by_hand(d).values())) + 1 for d in (0, 1, 2, 3, 9)}
    assert cluster.group_counts(chain(spark), nodes.where("id < 0"), [1]).collect() == []


def test_group_counts_leave_out_clusters_without_nodes(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 4), (7, 8, 1), (8, 9, 5)], "u long, v long, w int")
    nodes = spark.createDataFrame([(2,), (3,), (9,), (20,)], "id long")
    assert {r.level: r.n_groups for r in cluster.group_counts(edges, nodes, [0, 1, 4, 5]).collect()} == {0: 4, 1: 4, 4: 3, 5: 3}


def names_no_member(spark, sf, monkeypatch, name):
    def named(*_, **__):
        raise AssertionError("members are named")

    monkeypatch.setattr(cluster, "hierarchy", named)
    assert core_queries.Q[name](spark, sf).collect()


def test_all_level_group_counts_name_no_member(spark, sf, monkeypatch):
    names_no_member(spark, sf, monkeypatch, "all_level_group_counts")


def test_first_small_level_names_no_member(spark, sf, monkeypatch):
    names_no_member(spark, sf, monkeypatch, "first_small_level")


def test_cut_at_count_names_no_member(spark, sf, monkeypatch):
    names_no_member(spark, sf, monkeypatch, "cut_at_count")


def test_layouts_of_valleys(spark):
    forest = graph.spanning_forest(chain(spark), block_edges=40)
    rooted = graph.rooted_levels(forest)
    depth = {r.id: r.depth for r in rooted.select("id", "depth").collect()}
    assert set(depth) == set(ids()) and max(depth.values()) >= 2 * ARM
    for layout in (graph.tree_layout, graph.radial_layout, graph.hierarchical_layout):
        assert {r.id for r in layout(rooted).select("id").collect()} == set(ids())


def test_leaves_take_no_part_in_the_walk(spark, monkeypatch):
    walked, real = [], graph.pin
    monkeypatch.setattr(graph, "pin", lambda df, what="t": [t := real(df, what), what == "walk" and walked.append(t.count())][0])
    # a star with arms of two, a pair, and a chain
    edges = [(1, x, 1) for x in range(10, 30)] + [(x, x + 100, 1) for x in range(10, 30)] + [(5, 6, 1)] + [(x, x + 1, 1) for x in range(300, 308)]
    got = {r.id: (r.parent, r.root, r.depth) for r in graph.rooted_levels(spark.createDataFrame(edges, "u long, v long, w int")).collect()}
    want = {1: (None, 1, 0), 5: (None, 5, 0), 6: (5, 5, 1), 300: (301, 301, 1), 301: (None, 301, 0)}
    want |= {x: (1, 1, 1) for x in range(10, 30)} | {x + 100: (x, 1, 2) for x in range(10, 30)} | {x: (x - 1, 301, x - 301) for x in range(302, 309)}
    assert got == want
    assert max(walked) <= 16 < 2 * len(edges)


def test_profiles_in_a_chain(spark, monkeypatch):
    monkeypatch.setattr(pairs, "hierarchy", partial(cluster.hierarchy, block_edges=40))
    rows, now = [], [1] * 64
    for k, x in enumerate(ids()):
        for c in range(4):
            now[(4 * k + c) % 64] = k + 2
        rows.append((x, list(now)))
    got = {(r.level, r.sample_idx): r.cluster for r in pairs.profile_hierarchy(spark.createDataFrame(rows, "sample_idx long, alleles array<int>"), [3, 4]).collect()}
    assert got == {(3, x): x for x in ids()} | {(4, x): 0 for x in ids()}


def test_information_of_valleys(spark):
    nodes = spark.createDataFrame([(x,) for x in ids()], "id long")
    levels = cluster.hierarchy(chain(spark), nodes, [0, 1, 3], block_edges=40)
    got = {(r.level1, r.level2): r.nmi for r in evaluate.nested_information(levels).collect()}
    assert set(got) == {(0, 1), (0, 3), (1, 3)} and got[0, 3] == got[1, 3] == 0.0 and 0.8 < got[0, 1] < 0.999
