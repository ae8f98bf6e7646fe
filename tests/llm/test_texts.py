"""Packing, leak search and personal information."""

import base64
import quopri
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locuslake.llm import crf, labelled, leakage, mailtext, packing, privacy

ITEM = "Which orchard shades the silent raft first when 93 of the lantern pieces lie on the woven summit? Suppose that every hollow lantern near the valley swallows it."


def brute_bins(sizes, cap):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, b in enumerate(bins) if b + s <= cap]
        if fit:
            bins[max(fit, key=lambda i: bins[i])] += s
        else:
            bins.append(s)
    return len(bins)


def test_best_fit_and_bounds():
    r = random.Random(1)
    for _ in range(40):
        sizes = np.array([r.randint(0, 100) for _ in range(r.randint(1, 120))], np.int64)
        where, bins = packing.best_fit_decreasing(sizes, 100)
        assert np.bincount(where, weights=sizes).max() <= 100
        assert bins == max(1, brute_bins(sizes.tolist(), 100))
        assert packing.lower_bound(sizes, 100) <= bins
    assert packing.lower_bound(np.array([51] * 7), 100) == 7
    assert packing.lower_bound(np.array([34, 34, 34, 34]), 100) == 2


def test_every_piece_gets_one_container(spark):
    r = random.Random(2)
    rows = [(i, r.randint(0, 64)) for i in range(900)]
    pieces = spark.createDataFrame([(i, 0, 1, t) for i, t in rows] + [(5, 0, 1, 7)] * 3, "doc_id long, piece int, n_pieces int, tokens int")
    placed, report = packing.pack(pieces, 64, group_items=200)
    assert sorted((x.doc_id, x.tokens) for x in placed.collect()) == sorted(rows + [(5, 7)] * 3)
    fill = placed.groupBy("container").agg(F.sum("tokens").alias("t"))
    assert fill.where("t > 64").count() == 0
    top = placed.agg(F.max("container")).first()[0]
    assert fill.count() == top + 1 == report.agg(F.sum("containers")).first()[0]
    assert packing.pack(pieces.limit(0), 64)[0].count() == 0


def test_token_pieces(spark):
    long = "word " * 5000
    df = spark.createDataFrame([(1, "two words", "x"), (2, None, "x"), (3, "", "x"), (4, long, "x")], "doc_id long, text string, tokens string")
    got = [tuple(r) for r in packing.token_pieces(df, "doc_id", "text", 2048).orderBy("doc_id", "piece").collect()]
    assert got[:3] == [(1, 0, 1, 2), (2, 0, 1, 0), (3, 0, 1, 0)]
    assert [g[3] for g in got[3:-1]] == [2048] * (len(got) - 4) and sum(g[3] for g in got[3:]) >= 5000
    assert all(g[2] == len(got[3:]) for g in got[3:])


def edit_distance(a, b):
    best = 10**9
    for s in range(len(b) + 1):
        row = list(range(len(a) + 1))
        best = min(best, row[-1])
        for w in b[s:]:
            new = [row[0] + 1]
            for i, x in enumerate(a):
                new.append(min(row[i + 1] + 1, new[i] + 1, row[i] + (x != w)))
            row = new
            best = min(best, row[-1])
    return best


def test_myers_matches_dynamic_programming():
    r = random.Random(3)
    for _ in range(150):
        a = [r.choice([b"x", b"y", b"z"]) for _ in range(r.randint(1, 9))]
        b = [r.choice([b"x", b"y", b"z"]) for _ in range(r.randint(0, 12))]
        for limit in (0, 2, 9):
            assert leakage.myers(a, b, limit) == min(edit_distance(a, b), limit + 1)


def hidden(text):
    """The text in the ways mail hides it."""
    cut = text.split(" ")
    lines = "\n".join("| " + " ".join(cut[i : i + 6]) for i in range(0, len(cut), 6))
    tags = "<html><p>" + text.replace("silent", "<b>sil</b>ent").replace(" raft", "<br>raft") + "</p></html>"
    qp = "Content-Transfer-Encoding: quoted-printable\n\n" + quopri.encodestring(("ü " + tags).encode()).decode()
    b64 = "--x\nContent-Transfer-Encoding: base64\n\n" + base64.encodebytes(text.encode()).decode() + "--x--"
    return {"plain": text.upper(), "lines": lines, "tags": tags, "qp": qp, "b64": b64, "nested": lines.replace("| ", ">: ")}


def test_leaks_are_found_however_hidden(spark):
    docs = [(i, t) for i, (_, t) in enumerate(hidden("Intro text. " + ITEM + " Bye.").items())]
    words = ITEM.split()
    docs += [(50, "a b " + " ".join(words[4:16]) + " c"), (51, "a b " + " ".join(words[4:15]) + " c"), (52, None), (53, ""), (54, "x " * 200_000 + " ".join(words[:12])), (55, "nothing here")]
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (10, ITEM)], "item_id long, text string")
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(df, items).collect()}
    assert got == {(d, i) for d in (0, 1, 2, 3, 4, 5, 50, 54) for i in (7, 10)}
    near = {r.doc_id: r.edits for r in leakage.find_leaks(df, items.where("item_id = 7"), max_edits=1).collect()}
    assert near[51] == 1 and near[0] == 0
    assert leakage.find_leaks(df.limit(0), items).count() == leakage.find_leaks(df, items.limit(0)).count() == 0
    with pytest.raises(ValueError, match="more than 1"):
        leakage.find_leaks(df, items, max_items=1)


def test_text_behind_a_binary_head_and_in_short_lines():
    said = b"the quick brown fox jumps over the lazy dog while seven other animals look on"
    body = base64.b64encode(bytes(range(14, 32)) * 60 + said + bytes(range(0, 9)) * 40).decode()
    for width in (76, 32):
        lines = "\n".join(body[i : i + width] for i in range(0, len(body), width))
        got = mailtext.readings("Subject: x\n\n" + lines + "\n\nend")
        assert any(b" lazy dog while seven other " in r for r in got)
    assert mailtext.blob_runs(["Antoninus", "Bartholomew", "Constantine", "Alexandrina"]) == []


def test_closest_window_is_reported():
    item = [f"w{i}".encode() for i in range(40)]
    doc = [b"x"] * 5 + item[9:21] + [b"y"] * 5
    assert leakage.verified(doc, 5 + 3, item, 12, 4, 12, 1) == (0, 9)


def test_base64_without_text_is_left_out():
    noise = base64.encodebytes(bytes(random.Random(1).randbytes(600))).decode()
    rest, inside = mailtext.cut_blobs("Hello\n\n" + noise + "\nBye")
    assert inside == [] and rest.split() == ["Hello", "Bye"]


PEOPLE = [(g, f) for g in ("Anna", "Jonas", "Zothea", "Velmar", "Kirsa", "Orlin", "Quibert") for f in ("Keller", "Pellström", "O'Morvides", "al-Wendek", "Toskinger", "Brelouri")]


@pytest.fixture(scope="module")
def tagger():
    return privacy.Tagger(privacy.fit(PEOPLE, copies=10))


def test_held_out_accuracy(tagger):
    table = labelled.examples(PEOPLE, 2, seed=77)
    got = {(i, x, k) for i, x, _, k in tagger.spans([t for t, _ in table])}
    gold = {(i, a, k) for i, (_, spans) in enumerate(table) for a, _, k in spans}
    assert len(got & gold) >= 0.9 * len(gold)
    assert len(got - gold) <= 0.1 * len(gold)


def test_places_survive_encodings(tagger):
    plain = "Ask Anna Pellström about the old scheme.\n\nCall +999 4812 5538 if the door is locked.\n"
    qp = "Content-Transfer-Encoding: quoted-printable\n\n" + plain.replace("ö", "=C3=B6").replace("Pellstr", "Pell=\nstr")
    for text in (plain, qp):
        found = {(text[x : x + 4], k) for _, x, _, k in tagger.spans([text])}
        assert ("Anna", "person") in found and ("+999", "phone") in found
    alone = tagger.spans([plain])
    assert [(x, y, k) for _, x, y, k in alone] == [(x, y, k) for t, x, y, k in tagger.spans(["Other text.", plain, "x"]) if t == 1]


def test_redaction_of_a_table(spark):
    long = "Ask Anna Keller about the old scheme. " * 3000
    rows = [(1, "Write to anna.keller@mail.orlanth.example, not to the old box."), (2, None), (3, ""), (4, long), (5, "Freezer key P0834640 opens the missing report."), (1, " \x03 ")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, kind string")
    out = {r.doc_id: (r.text, r.n_found) for r in privacy.find_personal(df, redact=True, copies=4).where("n_found > 0 or text is null or doc_id in (3, 5)").collect()}
    assert out[1][0] == "Write to [EMAIL], not to the old box."
    assert out[2] == (None, 0) and out[3] == ("", 0) and out[5][1] == 0
    assert out[4][1] >= 2900 and "Keller" not in out[4][0].split("scheme.")[1]
    assert privacy.find_personal(df.limit(0), copies=4).count() == 0


def test_viterbi_matches_brute_force():
    import itertools

    r = np.random.default_rng(1)
    e, step = r.normal(size=(3, 5, 3)).astype(np.float32), r.normal(size=(3, 3)).astype(np.float32)
    ok = lambda p: p[0] != 2 and all(b != 2 or a in (1, 2) for a, b in zip(p, p[1:]))
    for w in range(3):
        paths = [p for p in itertools.product(range(3), repeat=5) if ok(p)]
        score = lambda p: sum(e[w, t, y] for t, y in enumerate(p)) + sum(step[a, b] for a, b in zip(p, p[1:]))
        assert tuple(crf.viterbi(e, step)[w]) == max(paths, key=score)
