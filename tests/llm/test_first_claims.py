"""Where no vote can overturn the first claim, no vote is counted."""

import glob
import os

import duckdb

from locuslake.llm import consolidate, queries


def test_found_fields_count_no_votes(spark, sf, monkeypatch):
    def counted(*_):
        raise AssertionError("votes are counted")

    monkeypatch.setattr(consolidate, "_per_source", counted)
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = {tuple(r) for r in queries.Q["p5_found"](spark, sf).select("cluster_id", "field_name", "sample_idx").collect()}
    assert got == set(con.sql(queries.SQL["p5_found"]).fetchall())
