import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locuslake.operators import packed

G = packed.grammar()


def places(text, pattern=G):
    return [(p, t) for p, t, _, _ in packed.parse_field(text, pattern)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (" 22,103,1_inf.507 ", [(1, "22"), (2, "103"), (3, "1"), (4, "inf.507")]),
        ("45 ; 8 ;  ; 2", [(1, "45"), (2, "8"), (3, ""), (4, "2")]),
        ("_12_", [(1, ""), (2, "12"), (3, "")]),
        ('3 "" 5', [(1, "3"), (2, ""), (3, "5")]),
        ('"x ""99"" y"_\'it\'\'s\' , 7', [(1, 'x "99" y'), (2, "it's"), (3, "7")]),
        ("L27='part/110'_2", [(1, "L27=part/110"), (2, "2")]),
        ("a b\t c  ,d", [(1, "a"), (2, "b"), (3, "c"), (4, "d")]),
        ('22,"5\' 3"  7', [(1, "22"), (2, "5' 3"), (3, "7")]),
        (None, []),
        ("", []),
        (" \t", []),
    ],
)
def test_places(text, want):
    assert places(text) == want


def test_malformed_quote_separates_and_is_flagged():
    got = packed.parse_field('a,"b c', G)
    assert [(t, bad) for _, t, _, bad in got] == [("a", False), ("", False), ("b", True), ("c", False)]


def test_brackets_group():
    got = packed.parse_field("[a, b],(c;d) e", packed.grammar(brackets="[]()"))
    assert [(t, k) for _, t, k, _ in got] == [("a, b", "bracketed"), ("c;d", "bracketed"), ("e", "bare")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",)), min_size=1, max_size=8), min_size=1, max_size=6), st.sampled_from([",", "_", " ; ", "|"]))
def test_quoting_round_trip(values, sep):
    text = sep.join('"' + v.replace('"', '""') + '"' for v in values)
    assert [t for _, t in places(text)] == values


def test_split_packed_frame(spark):
    long = "_".join(str(i) for i in range(20000))
    df = spark.createDataFrame([(1, "a_b", "x"), (1, "a_b", "x"), (2, None, None), (3, "", "y"), (4, long, "z"), (None, "q", "w")], "raw_id long, field string, token2 string")
    out = packed.split_packed(df, "field", ["raw_id"])
    assert out.where("raw_id = 1").count() == 4
    assert out.where("raw_id in (2, 3)").count() == 0
    assert out.where("raw_id = 4").count() == 20000
    assert out.where("raw_id is null").count() == 1
    assert packed.split_packed(df.limit(0), "field", ["raw_id"]).count() == 0
    with pytest.raises(ValueError, match="clash"):
        packed.split_packed(df.withColumnRenamed("token2", "token"), "field", ["token"])


def test_doubled_quote_is_not_split_and_brackets_stay_linear():
    import time

    pattern = packed.grammar()
    assert packed.parse_field('"a""b"', pattern) == [(1, 'a"b', "quoted", False)]
    assert packed.parse_field('"a""b', pattern) == [(1, "", "empty", False), (2, "ab", "mixed", True)]
    t = time.time()
    places = packed.parse_field("[a " * 60_000, packed.grammar(brackets="[]"), "[]")
    assert time.time() - t < 5 and sum(p[1] == "a" for p in places) == 60_000
