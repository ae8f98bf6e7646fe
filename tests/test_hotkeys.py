import datetime as dt

from pyspark.sql import functions as F

from locuslake.functions.text import organism_key
from locuslake.operators import hotkeys

T0 = dt.datetime(2024, 1, 1)


def brute(rows):
    out = {}
    for k, d, m, t in rows:
        n, ds, ms, lt = out.setdefault(k, [0, set(), set(), None])
        out[k] = [n + 1, ds | ({d} - {None}), ms | ({m} - {None}), t if lt is None else max(lt, t) if t else lt]
    return {k: (n, len(d), len(m), t) for k, (n, d, m, t) in out.items()}


def test_stats_with_a_hot_key_nulls_and_repeats(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", None if i % 11 == 0 else i % 50, None if i % 5 == 0 else f"u{i % 4}", None if i % 13 == 0 else T0 + dt.timedelta(hours=i)) for i in range(900)]
    rows += [(None, None, None, None)] * 3 + [("hot", 1, "u1", T0)] * 5
    df = spark.createDataFrame(rows, "key string, d int, m string, t timestamp_ntz").withColumn("chunk", F.lit("clash")).withColumn("_k", F.lit(1))
    got = {r["key"]: (r["n_rows"], r["n_d"], r["n_m"], r["latest"]) for r in hotkeys.chunked_key_stats(df, "key", "d", "t", members="m", chunk_rows=37, partitions=5).collect()}
    assert got == brute(rows)


def test_numbers_are_dense_and_ordered(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 4 > 0, "a").otherwise("b").alias("k"), (1000 - F.col("id")).alias("v"))
    rows = hotkeys.number_within_key(df, "k", ["v"], 7).collect()
    for key in "ab":
        mine = sorted((r["_n"], r["v"]) for r in rows if r["k"] == key)
        assert [n for n, _ in mine] == list(range(len(mine)))
        assert [v for _, v in mine] == sorted(v for _, v in mine)


def test_empty_table(spark):
    df = spark.createDataFrame([], "key string, d int, t timestamp_ntz")
    s = hotkeys.chunked_key_stats(df, "key", "d", "t")
    assert s.count() == 0
    assert hotkeys.heavy_keys(s, "key").count() == 0


def test_organism_key(spark):
    df = spark.createDataFrame([("  x y\t\r\n",), ("",), ("  ",), (None,), (" z",)], "o string")
    assert [r[0] for r in df.select(organism_key(F.col("o"))).collect()] == ["x y", "unknown", "unknown", "unknown", "z"]


def test_key_of_nulls_only_is_parted(spark):
    df = spark.range(4000).select(F.lit("hot").alias("key"), F.lit(None).cast("int").alias("d"), F.lit(None).cast("timestamp").alias("t"), F.col("id").alias("row"))
    placed = hotkeys.number_within_key(df, "key", ["d", "row"], 8).select("_n", F.spark_partition_id().alias("p"))
    assert placed.agg(F.count_distinct("_n")).first()[0] == 4000
    r = hotkeys.chunked_key_stats(df, "key", "d", "t", chunk_rows=100, partitions=8, tie="row").collect()
    assert [(x["n_rows"], x["n_d"], x["latest"], x["n_chunks"]) for x in r] == [(4000, 0, None, 40)]
