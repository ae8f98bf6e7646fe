import gzip
import lzma

import pytest
from pyspark.sql import functions as F

from locuslake.operators import cluster
from locuslake.sources import generators, readers, writers
from locuslake.streaming import incremental


def put(path, text):
    op = {".gz": gzip.open, ".xz": lzma.open}.get(path.suffix, open)
    with op(path, "wt") as f:
        f.write(text)
    return str(path)


def rows(profiles):
    return {r.st_id: (r.name, list(r.alleles)) for r in profiles.collect()}


@pytest.mark.parametrize("name", ["a.tsv", "a.tsv.gz", "a.tsv.xz"])
def test_identifier_format(spark, tmp_path, name):
    p, counts, loci = readers.read_profiles(spark, put(tmp_path / name, "ST\tgA\tgB\n3\t1\t0\n3\t9\t9\n-1\t1\t1\n5\t-2\t7\n"))
    assert loci == ["gA", "gB"]
    assert rows(p) == {3: ("3", [1, 0]), 5: ("5", [0, 7])}
    assert {(r.id, r.n) for r in counts.collect()} == {("3", 2), ("5", 1)}


def test_text_alleles_share_one_dictionary(spark, tmp_path):
    p, _, loci = readers.read_profiles(spark, put(tmp_path / "b.tsv", "#ST_id\tL1\t#note\tL2\nx\tA\tn\t7\ny\tb\tn\t\nz\t-5\tn\tA\n"))
    assert loci == ["L1", "L2"]
    assert rows(p) == {1: ("x", [8, 7]), 2: ("y", [9, 0]), 3: ("z", [0, 8])}


def test_token_format(spark, tmp_path):
    p, counts, loci = readers.read_profiles(spark, put(tmp_path / "c.csv", 'checksum,cgmlst,x\naa,12_7__d41d8cd98f00b204,1\nbb,"1,2",1\naa,9,1\n'))
    got = rows(p)
    assert loci == ["L1", "L2", "L3", "L4"]
    assert got[1][1] == [12, 7, 0, 0xD41D8CD98F00B204 % 2147483647]
    assert got[2][1] == [1, 2, 0, 0]
    assert counts.where("id = 'aa'").first()["n"] == 2


def test_matrix_format_and_errors(spark, tmp_path):
    p, _, loci = readers.read_profiles(spark, put(tmp_path / "d.txt", "1 2 3\n4 0 -6\n"))
    assert loci == ["L1", "L2", "L3"] and rows(p) == {1: ("1", [1, 2, 3]), 2: ("2", [4, 0, 0])}
    with pytest.raises(ValueError):
        readers.read_profiles(spark, put(tmp_path / "e.txt", ""))
    with pytest.raises(ValueError):
        readers.read_profiles(spark, put(tmp_path / "f.txt", "abc\ndef\n"))


def test_evaluation_round_trip(spark, tmp_path):
    sil = spark.createDataFrame([(0, 0.25), (5, 0.5)], "level int, x double")
    nmi = spark.createDataFrame([(0, 5, 0.75)], "level1 int, level2 int, x double")
    writers.write_evaluation(sil, nmi, [0, 5], str(tmp_path / "e"))
    got = {(r.section, r.label, r.other): r.x for r in readers.read_evaluation(spark, str(tmp_path / "e")).collect()}
    assert got[("silhouette", "HC5", None)] == 0.5 and got[("nmi", "HC0", "HC5")] == got[("nmi", "HC5", "HC0")] == 0.75


def test_hierarchy_sinks(spark, tmp_path):
    h = spark.createDataFrame([(1, 0, 1), (2, 0, 2), (1, 5, 1), (2, 5, 1)], "id long, level int, cluster long")
    writers.write_hierarchy(h, str(tmp_path / "h"))
    assert {(r.id, r.cluster) for r in readers.read_level(spark, str(tmp_path / "h"), 5).collect()} == {(1, 1), (2, 1)}
    writers.write_hierarchy_text(h, [0, 5], str(tmp_path / "t"))
    assert readers.read_table(spark, str(tmp_path / "t"), "\t").columns == ["#ST_id", "HC0", "HC5"]


def test_profile_and_metadata_sinks(spark, tmp_path):
    p = spark.createDataFrame([(1, "1", [3, 4])], "st_id long, name string, alleles array<int>")
    writers.write_profiles(p, ["a", "b"], str(tmp_path / "p"))
    assert readers.read_table(spark, str(tmp_path / "p"), "\t").first().asDict() == {"ST": "1", "a": "3", "b": "4"}
    c = spark.createDataFrame([(7, 1, [1, 2])], "cluster_id long, rep_idx long, members array<long>")
    writers.write_collapse_metadata(c, 4.0, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()["sample_counts"] == 2
    writers.write_coordinates(spark.createDataFrame([(1, 0.5, 0.5)], "id long, x double, y double"), str(tmp_path / "xy"))
    assert spark.read.csv(str(tmp_path / "xy"), header=True).count() == 1


def test_split_keeps_every_row(spark, tmp_path):
    df = spark.createDataFrame([("a/b", i) for i in range(50)] + [(None, 1), ("c", 2)], "organismid string, v int")
    counts = writers.split_by_organism(df, F.coalesce("organismid", F.lit("unknown")), str(tmp_path / "s"), files_rows=10)
    assert {(r.folder, r.n) for r in counts.collect()} == {("a_b", 50), ("unknown", 1), ("c", 1)}
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 52
    assert writers.organism_column(["x", "OrganismID"]) == "OrganismID"


def test_planted_clusters_are_found(spark):
    from locuslake.operators.distance import pair_distances

    p = generators.planted_clusters(spark, loci=64).withColumn("sample_idx", F.xxhash64("name"))
    ids = p.select(F.col("sample_idx").alias("i")).crossJoin(p.select(F.col("sample_idx").alias("j"))).where("i < j")
    d = pair_distances(ids, p, 64)
    edges = d.select(F.col("i").alias("u"), F.col("j").alias("v"), F.col("d0").alias("w"))
    lab = cluster.labels_at(edges, p.select(F.col("sample_idx").alias("id")), 20)
    pairs = lab.join(p, F.col("id") == F.col("sample_idx")).select("label", "truth").distinct()
    assert pairs.count() == 3 and pairs.select("label").distinct().count() == 3
    assert generators.nested_clusters(spark).count() == 45
    assert generators.random_distances(spark, 20).count() == 190


def test_streams(spark, tmp_path, sf):
    schema = spark.read.parquet(f"{sf}/cgmlst_supp_species.parquet").schema
    src = tmp_path / "in"
    spark.read.parquet(f"{sf}/cgmlst_supp_species.parquet").write.parquet(str(src))
    stream = lambda: spark.readStream.schema(schema).parquet(str(src))
    q = stream().writeStream.foreachBatch(incremental.split_sink(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == spark.read.parquet(str(src)).count()
    w = incremental.loads_per_window(stream()).writeStream.format("memory").queryName("per_window").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert spark.table("per_window").agg(F.sum("n")).first()[0] == spark.read.parquet(str(src)).count()


def test_incremental_assignment(spark, tmp_path):
    sink = incremental.assignment_sink(str(tmp_path / "a"), 7)
    make = lambda rows: spark.createDataFrame(rows, "i long, j long, d0 int")
    sink(make([(1, 2, 3), (4, 5, 2), (7, 8, 30)]), 0)
    sink(make([(2, 4, 7), (9, 9, 0)]), 1)
    last = spark.read.parquet(str(tmp_path / "a/labels/epoch=1"))
    assert {(r.id, r.label) for r in last.collect()} == {(1, 1), (2, 1), (4, 1), (5, 1)}
