"""Command line: cluster profiles or a table of compared pairs, split submissions, generate profiles."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .functions.text import organism_key
from .operators import cluster, graph
from .plans import pipeline
from .session import build_session
from .sources import generators, writers


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="locuslake", description=__doc__)
    p.add_argument("--master", help="Spark master; leave out under spark-submit")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("cluster", help="levels of single-linkage clusters of a pair table (parquet: i, j, d0)")
    c.add_argument("pairs")
    c.add_argument("out")
    c.add_argument("--levels", type=int, nargs="+", default=[0, 3, 7, 12, 20])
    r = sub.add_parser("run", help="levels, group counts and collapsed clusters of a profile table (parquet: sample_idx, alleles)")
    r.add_argument("profiles")
    r.add_argument("out")
    r.add_argument("--levels", type=int, nargs="+", default=[0, 2, 5, 7])
    r.add_argument("--loci", type=int, default=64)
    r.add_argument("--target", type=int, help="about how many collapsed clusters")
    s = sub.add_parser("split", help="one folder per organism of a submission table (parquet)")
    s.add_argument("table")
    s.add_argument("out")
    s.add_argument("--overwrite", action="store_true")
    g = sub.add_parser("generate", help="synthetic planted clusters")
    g.add_argument("out")
    g.add_argument("--clusters", type=int, default=3)
    g.add_argument("--size", type=int, default=20)
    g.add_argument("--loci", type=int, default=50)
    a = p.parse_args(argv)
    spark = build_session(master=a.master)
    if a.command == "cluster":
        edges = graph.valid_edges(spark.read.parquet(a.pairs))
        nodes = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
        writers.write_hierarchy(cluster.hierarchy(edges, nodes, a.levels), a.out)
    elif a.command == "run":
        pipeline.run(spark.read.parquet(a.profiles), a.out, a.levels, a.loci, a.target)
    elif a.command == "split":
        df = spark.read.parquet(a.table)
        writers.split_by_organism(df, organism_key(F.col(writers.organism_column(df.columns))), a.out, a.overwrite).show()
    else:
        generators.planted_clusters(spark, a.clusters, a.size, a.loci).write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
