import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from locuslake.operators import cluster, distance, evaluate, graph, pairs, series
from locuslake.operators.profiles import alleles_from_columns, distinct_profiles
from locuslake.plans import core_queries, pipeline


def d0_by_hand(a, b, am=0.05):
    loci = len(a)
    al = sum(x > 0 and y > 0 for x, y in zip(a, b)) + 1e-12
    ad = sum(x > 0 and y > 0 and x != y for x, y in zip(a, b))
    ll = max(sum(x > 0 for x in a), sum(y > 0 for y in b)) - am * loci
    if ll > al:
        ad, al = ad + ll - al, ll
    return int(np.floor(ad / al * loci + 0.5))


def random_profiles(n, loci=64, seed=1):
    r = random.Random(seed)
    base = [[r.randint(1, 9) for _ in range(loci)] for _ in range(3)]
    out = []
    for i in range(n):
        p = [x if r.random() > 0.1 else r.randint(1, 9) for x in base[i % 3]]
        out.append([0 if r.random() < r.choice([0, 0.02, 0.3]) else x for x in p])
    return out


def test_block_distance_matches_definition():
    p = np.array(random_profiles(30), np.int32)
    p[0] = 0
    d = distance.block_d0(p, p)
    for i, j in itertools.product(range(30), repeat=2):
        assert d[i, j] == d0_by_hand(p[i].tolist(), p[j].tolist())
    for t in (0, 7, 20, 64):
        assert (distance.block_within(p, p, t, rows=7) == (d <= t)).all()


def test_expression_distance_matches_block(spark):
    p = random_profiles(20)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "sample_idx long, alleles array<int>")
    pairs = spark.createDataFrame([(i, j) for i in range(20) for j in range(i)], "i long, j long")
    d = distance.block_d0(np.array(p, np.int32), np.array(p, np.int32))
    for r in distance.pair_distances(pairs, df, 64).collect():
        assert r.d0 == d[r.i, r.j]
        assert r.d1 <= r.d0 <= 64


def test_profiles_encode_missing(spark):
    df = spark.createDataFrame([(1, None, -5, 7), (2, 0, 0, 7), (3, 1, 1, 1)], "sample_idx long, l1 int, l2 int, l3 int").select("sample_idx", alleles_from_columns(["l1", "l2", "l3"]).alias("alleles"))
    assert {(r.rep, r.n) for r in distinct_profiles(df).collect()} == {(1, 2), (3, 1)}


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "u long, v long, w int")


def brute_components(edges, nodes):
    label = {x: x for x in nodes}
    for _ in nodes:
        for u, v, _ in edges:
            label[u] = label[v] = min(label[u], label[v])
    return label


def test_components_both_ways(spark):
    r = random.Random(2)
    rows = [(u, v, r.randint(0, 9)) for u, v in ((r.randint(0, 150), r.randint(0, 150)) for _ in range(110)) if u < v]
    nodes = {x for u, v, _ in rows for x in (u, v)}
    want = brute_components(rows, nodes)
    for block in (10**6, 5):
        assert {x.id: x.label for x in graph.components(edges_of(spark, rows), block_edges=block).collect()} == want
    assert graph.components(edges_of(spark, [])).count() == 0


def test_spanning_forest_both_ways(spark):
    r = random.Random(3)
    rows = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), r.randint(0, 20)) for a, b in ((r.randint(0, 40), r.randint(0, 40)) for _ in range(300)) if a != b}.values())
    u, v, w = (np.array(c) for c in zip(*rows))
    want = {rows[i][:2] for i in graph.kruskal(u, v, w)}
    for block in (10**6, 25):
        assert {(x.u, x.v) for x in graph.spanning_forest(edges_of(spark, rows), block_edges=block).collect()} == want


def test_hierarchy_is_nested_and_named_by_smallest(spark):
    r = random.Random(4)
    rows = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), r.randint(0, 20)) for a, b in ((r.randint(0, 60), r.randint(0, 60)) for _ in range(120)) if a != b}.values())
    nodes = spark.range(62)
    h = {(x.level, x.id): x.cluster for x in cluster.hierarchy(edges_of(spark, rows), nodes, [2, 8, 20]).collect()}
    for level in (2, 8, 20):
        want = brute_components([e for e in rows if e[2] <= level], range(62))
        assert all(h[level, i] == want[i] for i in range(62))


def test_collapse_curve_and_threshold(spark):
    f = edges_of(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 4), (3, 4, 9)])
    curve = cluster.collapse_curve(f, 5)
    assert {(x.w, x.n_clusters) for x in curve.collect()} == {(1, 5), (4, 3), (9, 2)}
    assert cluster.collapse_threshold(curve, 3).first()["threshold"] == 4


def test_dbscan(spark):
    near = [(0, 1), (0, 2), (1, 2), (2, 3), (5, 6)]
    lab = {x.id: (x.label, x.role) for x in cluster.dbscan(edges_of(spark, [(u, v, 1) for u, v in near]), spark.range(8), 2, 3).collect()}
    assert lab[0] == lab[1] == lab[2] == (0, "core")
    assert lab[3] == (0, "border")
    assert lab[5] == lab[7] == (-1, "noise")


def test_silhouette_of_two_clear_clusters(spark):
    rows = [(i, j, 1 if i // 3 == j // 3 else 9) for i in range(6) for j in range(i + 1, 6)]
    labels = spark.createDataFrame([(i, i // 3) for i in range(6)], "id long, label long")
    s = evaluate.silhouettes(graph.symmetrised(edges_of(spark, rows)), labels).collect()
    assert all(abs(x.s - 8 / 9) < 1e-5 for x in s)


def test_mutual_information_bounds(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, label long")
    b = spark.createDataFrame([(i, i % 3 + 5) for i in range(30)], "id long, label long")
    c = spark.createDataFrame([(i, i // 3 % 2) for i in range(30)], "id long, label long")
    assert evaluate.mutual_information(a, b).first()[0] == 0.999
    assert 0 <= evaluate.mutual_information(a, c).first()[0] < 0.2


def test_series(spark):
    s = spark.createDataFrame([(i, float(x)) for i, x in enumerate([0, 0, 3, 3, 0, 1, 0, 5, 0])], "idx int, x double")
    assert {(r.start, r.end) for r in series.plateaus(s, 0.1, 2).collect()} == {(0, 2), (2, 4)}
    assert {(r.idx, r.prominence) for r in series.peaks(s, 0.5, 0.5).collect()} == {(2, 3.0), (5, 1.0), (7, 5.0)}
    assert series.scaled(s).agg(F.max("x")).first()[0] == 1.0
    assert tuple(series.first_two(spark.createDataFrame([], "idx int")).first()) == (0, None)


def test_layouts(spark):
    levels = graph.rooted_levels(edges_of(spark, [(0, 1, 1), (0, 2, 1), (0, 3, 1), (3, 4, 2)]))
    assert {(r.id, r.parent, r.depth) for r in levels.collect()} == {(0, None, 0), (1, 0, 1), (2, 0, 1), (3, 0, 1), (4, 3, 2)}
    tree = {r.id: (r.x, r.y) for r in graph.tree_layout(levels).collect()}
    assert tree[0] == (0.0, 0.0) and tree[4][1] == -2.0 and tree[1][0] < tree[2][0] < tree[3][0]
    assert graph.radial_layout(levels).count() == graph.hierarchical_layout(levels).count() == 5


def test_layouts_of_deep_forest_place_every_node(spark):
    r = random.Random(5)
    chain = [(i, i + 1, 1) for i in range(150)]
    bush = [(200 + r.randint(0, i - 1), 200 + i, 30) for i in range(1, 40)]
    rows = chain + bush
    adj = {}
    for u, v, _ in rows:
        adj.setdefault(u, []).append(v)
        adj.setdefault(v, []).append(u)
    want, tree, angle, left = {}, {}, {}, {*adj, 500, 501}
    while left:
        root = min(left, key=lambda x: (-len(adj.get(x, [])), x))
        want[root], tree[root], angle[root], queue = (None, root, 0), (0.0, 2.0), (0.0, 2 * np.pi), [root]
        for at in queue:
            left.remove(at)
            kids = sorted(x for x in adj.get(at, []) if x != want[at][0])
            for k, kid in enumerate(kids):
                want[kid] = (at, root, want[at][2] + 1)
                (x, w), (a, s) = tree[at], angle[at]
                dx = w / (len(kids) + 1)
                tree[kid] = (x - w / 2 - dx / 2 + (k + 1) * dx, dx)
                angle[kid] = (a - s / 2 + (k + 0.5) * s / len(kids), s / len(kids))
            queue += kids
    nodes = spark.createDataFrame([(x,) for x in want], "id long")
    levels = graph.rooted_levels(edges_of(spark, rows), nodes)
    assert {x.id: (x.parent, x.root, x.depth) for x in levels.collect()} == want
    got = {x.id: (x.x, x.y) for x in graph.tree_layout(levels).collect()}
    assert got.keys() == want.keys() and all(abs(got[x][0] - tree[x][0]) < 2e-6 and got[x][1] == -want[x][2] for x in want)
    got = {x.id: (x.x, x.y) for x in graph.radial_layout(levels).collect()}
    assert got.keys() == want.keys() and all(abs(got[x][0] - want[x][2] * np.cos(angle[x][0])) < 2e-6 and abs(got[x][1] - want[x][2] * np.sin(angle[x][0])) < 2e-6 for x in want)


def test_layout_queries_place_every_sample(spark, sf):
    n = spark.read.parquet(f"{sf}/cgmlst_profile.parquet").count()
    for name in ("tree_layout", "radial_layout", "hierarchical_layout"):
        out = core_queries.Q[name](spark, sf)
        assert out.count() == out.select("id").distinct().count() == n


def test_hierarchy_of_every_level_in_blocks_and_rounds(spark):
    r = random.Random(6)
    rows = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), r.randint(0, 64)) for a, b in ((r.randint(0, 80), r.randint(0, 80)) for _ in range(130)) if a != b}.values())
    # a block for all levels, one for the levels under 50, and rounds for a level with more edges than a block
    for levels, block in ((range(65), 200_000), ([0, 20, 49, 50, 64], 25)):
        got = {(x.level, x.id): x.cluster for x in cluster.hierarchy(edges_of(spark, rows), spark.range(82), list(levels), block_edges=block).collect()}
        assert len(got) == 82 * len(levels)
        for level in levels:
            want = brute_components([e for e in rows if e[2] <= level], range(82))
            assert all(got[level, i] == want[i] for i in range(82))


def test_evaluation_of_levels_together_equals_one_by_one(spark):
    r = random.Random(7)
    rows = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), r.randint(0, 20)) for a, b in ((r.randint(0, 40), r.randint(0, 40)) for _ in range(90)) if a != b}.values())
    h = spark.createDataFrame(cluster.hierarchy(edges_of(spark, rows), spark.range(42), [0, 4, 9]).collect())
    at = lambda d: h.where(F.col("level") == d).select("id", F.col("cluster").alias("label"))
    both = graph.symmetrised(edges_of(spark, rows))
    together = {(x.level, x.id): x.s for x in evaluate.silhouettes(both, h.withColumnRenamed("cluster", "label"), ("level",)).collect()}
    assert together == {(d, x.id): x.s for d in (0, 4, 9) for x in evaluate.silhouettes(both, at(d)).collect()}
    nmi = {(x.level1, x.level2): x.nmi for x in evaluate.nested_information(h).collect()}
    assert nmi.keys() == {(0, 4), (0, 9), (4, 9)}
    assert all(abs(x - evaluate.mutual_information(at(a), at(b)).first()[0]) < 2e-6 for (a, b), x in nmi.items())


def test_level_queries_cover_the_whole_range(spark, sf):
    want = set(range(65))  # under 1,000 samples every level is evaluated
    assert {x.level for x in core_queries.Q["all_level_group_counts"](spark, sf).collect()} == want
    assert {x.level for x in core_queries.Q["silhouette_levels"](spark, sf).collect()} == want
    assert {(x.level1, x.level2) for x in core_queries.Q["nmi_levels"](spark, sf).collect()} == {(a, b) for a in want for b in want if a < b}


def test_breakpoints_are_peaks(spark):
    r = random.Random(8)
    for n, x in ((0, [0.1, 0.2, 0.3, 0.4, 0.5]), (5, [r.choice([0.05, 0.1, 0.16, 0.17, 0.3, 0.5, 0.52]) for _ in range(40)])):
        drop = [round(r.random(), 3) for _ in x[1:]] + [0.0]
        best = []
        for i in range(1, len(x) - 1):
            lo, hi = i, i  # a flat top counts at its middle
            while lo and x[lo - 1] == x[i]:
                lo -= 1
            while hi < len(x) - 1 and x[hi + 1] == x[i]:
                hi += 1
            if x[i] < 0.15 or i != (lo + hi) // 2 or lo == 0 or hi == len(x) - 1 or x[lo - 1] > x[i] or x[hi + 1] > x[i]:
                continue
            left, right = i, i
            while left >= 0 and x[left] <= x[i]:
                left -= 1
            while right < len(x) and x[right] <= x[i]:
                right += 1
            if x[i] - max(min(x[left + 1 : i + 1]), min(x[i:right])) >= 0.03:
                best.append((i, 0.6 * (x[i] - min(x)) / (max(x) - min(x)) + 0.4 * drop[i] / max(drop)))
        want = sorted(best, key=lambda p: -p[1])[:5]
        assert len(want) == n
        got = series.breakpoint_scores(spark.createDataFrame(list(enumerate(x)), "idx int, x double"), spark.createDataFrame([(i, 1 - d) for i, d in enumerate(drop[:-1])], "idx int, x double")).collect()
        assert [p.idx for p in got] == [i for i, _ in want]
        assert all(abs(p.score - s) < 2e-5 for p, (_, s) in zip(got, want, strict=True))


def family_profiles(n, seed, loci=64):
    r = random.Random(seed)
    out = []
    while len(out) < n:
        base = [r.randint(1, 200) for _ in range(loci)]
        for _ in range(r.randint(1, 30)):
            p = [x if r.random() > 0.04 else r.randint(1, 200) for x in base]
            out += [[0 if r.random() < 0.02 else x for x in p]] * r.choice([1, 1, 3])
    return out[:n]


def test_profiles_to_hierarchy_without_all_pairs(spark):
    p = family_profiles(300, 4) + [[0] * 64, [0] * 62 + [5, 0]]
    a = np.array(p, np.int32)
    d = distance.block_d0(a, a)
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(p)], "sample_idx long, alleles array<int>, rep int")
    got = {(r.level, r.sample_idx): r.cluster for r in pairs.profile_hierarchy(df, [0, 3, 7]).collect()}
    for level in (0, 3, 7):
        want = brute_components([(int(i), int(j), 0) for i, j in zip(*np.nonzero(d <= level)) if i < j], range(len(p)))
        assert all(got[level, i] == want[i] for i in range(len(p)))
    distinct = df.groupBy("alleles").agg(F.min("sample_idx").alias("rep"))
    few, many = (pairs.linking_edges(distinct, 7, chunk=c) for c in (8, 1024))
    labels = lambda e: {(r.id, r.label) for r in graph.components(e).collect()}
    assert labels(few) == labels(many)
    assert pairs.linking_edges(distinct.limit(0), 7).count() == 0


def test_pipeline_writes_levels_and_collapsed_profiles(spark, tmp_path):
    p = family_profiles(120, 6)
    df = spark.createDataFrame(list(enumerate(p)), "sample_idx long, alleles array<int>")
    paths = pipeline.run(df, str(tmp_path), [0, 7], 64, target=40)
    assert spark.read.parquet(paths["hierarchy"]).count() == 240
    assert {r.level for r in spark.read.parquet(paths["group_counts"]).collect()} == {0, 7}
    flat = spark.read.parquet(paths["collapsed"]).collect()
    assert sorted(r["id"] for r in flat) == list(range(120))
    assert all(list(r.alleles) == p[r.rep] for r in flat)


def test_radii_together_equal_one_by_one(spark):
    r = random.Random(9)
    rows = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), r.randint(0, 30)) for a, b in ((r.randint(0, 60), r.randint(0, 60)) for _ in range(400)) if a != b}.values())
    e, nodes = edges_of(spark, rows), spark.range(64)
    radii = spark.createDataFrame([(0, 3.0), (1, 8.0), (2, 15.0)], "k int, eps double")
    each = {(x.k, x.id): x.label for x in cluster.dbscan_each(e, nodes, radii, 4).collect()}
    for k, eps in ((0, 3), (1, 8), (2, 15)):
        one = {x.id: x.label for x in cluster.dbscan(e, nodes, eps, 4).collect()}
        names = {}
        for i in range(64):
            assert (one[i] == -1) == (each[k, i] == -1)
            assert names.setdefault(one[i], each[k, i]) == each[k, i]
    assert cluster.eps_choice(e, nodes, 4, 5).count() == 1
