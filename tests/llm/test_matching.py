"""Components, canonical records, truth discovery."""

import datetime as dt
import random

from pyspark.sql import functions as F

from locuslake.llm import canonical, components, consolidate

T0 = dt.datetime(2024, 1, 1)


def brute(pairs):
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for u, v in pairs:
            label[u] = label[v] = min(label[u], label[v])
    return label


def test_hash_to_min_on_chains_stars_and_dirt(spark):
    r = random.Random(5)
    pairs = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)]
    dirty = [(b, a) for a, b in pairs[:20]] + pairs[:20] + [(None, 3), (5, None), (None, None), (999, 999)]
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs + dirty], "u long, v long, low string")
    got = {x.vertex: x.group_id for x in components.hash_to_min(df).collect()}
    assert got == brute([(a, b) for a, b in pairs if a != b])
    assert components.hash_to_min(df.limit(0)).count() == 0


def test_list_links_join_members_by_a_star(spark):
    df = spark.createDataFrame([([5, 3, None, 3, 9],), ([4],), (None,), ([],), ([None, None],)], "m array<long>")
    assert {tuple(r) for r in components.list_links(df, "m").collect()} == {(3, 5), (3, 9)}


def test_records_in_other_spelling(spark):
    rows = [
        (1, "ST 12", "1_2_A7"), (2, "#12", "1,2,a-7"), (3, "st_12", '"1" "2" \'A7\''), (4, "12", "L3:a7;l1=1;L2:2"), (5, "12", "1_2_A8"), (6, "13", "1_2_A7"),
        (7, None, "1_2_A7"), (8, "12", ""), (9, "12", None), (10, "12", " "), (11, "ST 12", "1_2_A7"), (12, "12", "1_2_A7_-_"), (13, None, None), (None, "12", "1_2_A7"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "raw_id long, st string, cgmlst string, tuple string")
    got = {r.raw_id: r.first_id for r in canonical.encode_records(df, "raw_id", "st", "cgmlst").collect()}
    assert all(got[i] == 1 for i in (1, 2, 3, 4, 11, 12))
    assert all(got[i] == i for i in (5, 6, 7, 8, 9, 10, 13))
    assert canonical.encode_records(df.limit(0), "raw_id", "st", "cgmlst").count() == 0


def test_large_locus_numbers_stay_apart(spark):
    rows = [(1, "5", "L1:7"), (2, "5", "L16777217:7"), (3, "5", "l00000001=7"), (4, "5", "L123456789012:7"), (5, "5", "l123456789012=7")]
    got = {r.raw_id: r.first_id for r in canonical.encode_records(spark.createDataFrame(rows, "raw_id long, st string, cgmlst string"), "raw_id", "st", "cgmlst").collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}


def test_one_hub_of_most_pairs(spark):
    pairs = spark.createDataFrame([(7, i) for i in range(100, 3100)] + [(3099, 5), (50, 51)], "u long, v long")
    got = {r.vertex: r.group_id for r in components.hash_to_min(pairs).collect()}
    assert len(got) == 3004 and got[51] == 50 and {v for k, v in got.items() if k not in (50, 51)} == {5}


def test_long_record_is_read_whole(spark):
    a = "_".join(str(i) for i in range(3000))
    df = spark.createDataFrame([(1, "1", a), (2, "1", a.replace("_", ",")), (3, "1", a + "_x")], "raw_id long, st string, cgmlst string")
    assert {r.raw_id: r.first_id for r in canonical.encode_records(df, "raw_id", "st", "cgmlst").collect()} == {1: 1, 2: 1, 3: 3}


CLAIMS = "group_id long, member long, source string, ts timestamp_ntz, field_name string, value string, rank int, cls string"


def claim(g, m, s, t, f, v):
    return (g, m, s, t, f, v, 1, "clash")


def test_best_vote_follows_trust_then_time_then_member(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    rows = [
        claim(1, 10, "low", day(9), "name", "a"), claim(1, 11, "high", day(1), "name", "b"), claim(1, 12, "high", day(2), "name", "c"), claim(1, 13, "high", None, "name", "d"),
        claim(2, 20, None, day(5), "name", "e"), claim(2, 21, "nowhere", day(5), "name", "f"), claim(3, 30, "high", None, "name", "g"), claim(3, 31, "high", None, "name", "g"), claim(3, 31, "high", None, "name", "g"), claim(4, 40, "x", None, "name", None),
    ]
    trust = spark.createDataFrame([("high", 1), ("high", 1), ("low", 3), (None, 1)], "source string, rank int")
    truth, rel = consolidate.discover_truth(spark.createDataFrame(rows, CLAIMS), trust, vote="best")
    assert {r.group_id: r.member for r in truth.collect()} == {1: 12, 2: 20, 3: 30}
    assert rel.count() == 3
    empty, _ = consolidate.discover_truth(spark.createDataFrame([], CLAIMS), trust, vote="best")
    assert empty.count() == 0


def test_votes_learn_which_source_is_wrong(spark):
    r = random.Random(1)
    rows = []
    for g in range(60):
        good = f"v{g}"
        for s, right in (("a", 0.95), ("b", 0.9), ("liar", 0.1), ("liar2", 0.1)):
            rows.append(claim(g, g * 10 + len(rows) % 10, s, None, "f", good if r.random() < right else f"w{r.randint(0, 9)}"))
    truth, rel = consolidate.discover_truth(spark.createDataFrame(rows, CLAIMS))
    assert sum(t.value == f"v{t.group_id}" for t in truth.collect()) >= 55
    w = {x.source: x.reliability for x in rel.collect()}
    assert min(w["a"], w["b"]) > max(w["liar"], w["liar2"])


def test_reliable_sources_overrule_a_weak_prior_but_not_its_limit(spark):
    rows = [claim(g, g * 10 + i, s, T0 + dt.timedelta(days=1), "f", f"v{g}") for g in range(40) for i, s in enumerate(("a", "b", "c"))]
    rows += [claim(g, g * 10 + 9, "boss", T0 + dt.timedelta(days=1), "f", f"w{g}" if g % 4 else f"v{g}") for g in range(40)]
    trust = spark.createDataFrame([("boss", 1), ("a", 2), ("b", 3), ("c", 4)], "source string, rank int")
    df = spark.createDataFrame(rows, CLAIMS)
    pick = lambda **how: {r.group_id: r.value for r in consolidate.discover_truth(df, trust, **how)[0].collect()}
    declared = {g: f"w{g}" if g % 4 else f"v{g}" for g in range(40)}
    assert pick(vote="best") == declared
    assert pick(prior=0.1) == {g: f"v{g}" for g in range(40)}
    rel = {r.source: r.reliability for r in consolidate.discover_truth(df, trust, prior=0.1)[1].collect()}
    assert rel["1"] < 0.4 < rel["2"]


def test_learned_reliability_decides_between_equal_votes(spark):
    rows = [claim(g, g * 10 + i, s, None, "f", f"v{g}") for g in range(30) for i, s in enumerate(("a", "b", "c"))] + [claim(g, g * 10 + 9, "liar", None, "f", f"w{g}") for g in range(30)]
    # here two stand against two; the liar and the unknown have the smaller members
    rows += [claim(99, m, s, None, "f", v) for m, s, v in ((1, "liar", "x"), (2, "d", "x"), (3, "a", "y"), (4, "b", "y"))]
    truth, _ = consolidate.discover_truth(spark.createDataFrame(rows, CLAIMS))
    assert {r.group_id: r.value for r in truth.collect()}[99] == "y"


def test_known_text(spark):
    said = ["n/a", "N.A.", "Not known", "-", "", None, "12", "Norvale", "NA-7", " tbd "]
    df = spark.createDataFrame([(x,) for x in said], "c string")
    assert [r[0] for r in df.select(consolidate.known_text(F.col("c"))).collect()] == [False] * 7 + [True, True, False]
