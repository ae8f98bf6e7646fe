from locuslake.operators import evaluate
from locuslake.plans import core_queries


def test_labels_are_not_joined_back(spark, sf, monkeypatch):
    want = evaluate.davies_bouldin(*_long_and_labels(spark, sf)).first().db

    def joined(*_):
        raise AssertionError("labels are joined to the samples again")

    monkeypatch.setattr(evaluate, "davies_bouldin", joined)
    assert core_queries.Q["davies_bouldin"](spark, sf).first().db == want


def _long_and_labels(spark, sf):
    p = core_queries.load_profiles(spark, sf, ["lab_code"])
    return p.selectExpr("sample_idx as id", "posexplode(alleles) as (k, a)").selectExpr("id", "k", "double(a > 0) as x"), p.selectExpr("sample_idx as id", "coalesce(lab_code, 'NA') as label")
