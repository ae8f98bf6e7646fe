"""Quality of clusterings over a pair table: silhouette, mutual information, Davies-Bouldin, permutation tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import pin
from .hotkeys import number_within_key


def silhouettes(both: DataFrame, labels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``id, label, s`` over the pairs that are listed; ``both``: i, j, w in both directions.

    Means run over listed pairs only. A sample whose cluster has one member, or
    with no listed pair inside or outside its cluster, gets 0. ``by`` names columns
    of ``labels`` that part it into labelings of the same samples, kept in the result.
    """
    lab = labels.select(*by, "id", "label")
    size = lab.groupBy(*by, "label").agg(F.count("*").alias("n"))
    if by:
        # the labels of a sample travel in one row, so pairs are moved twice whatever the labelings, and are listed by labeling where they are added up
        part = F.struct(*by)
        entry = F.struct(part.alias("part"), "label")
        theirs = lab.groupBy(F.col("id").alias("j")).agg(F.collect_list(entry).alias("theirs"))  # a sample listed twice counts twice
        own = lab.groupBy(F.col("id").alias("i")).agg(F.map_from_entries(F.collect_set(entry)).alias("own"))
        placed = both.join(theirs, "j").select("i", "w", "theirs").join(own, "i").select("i", "w", "own", F.explode("theirs").alias("x"))
        d = placed.select(*[F.col(f"x.part.{c}").alias(c) for c in by], "i", "w", F.col("x.label").alias("lj"), F.try_element_at("own", F.col("x.part")).alias("li")).where("li is not null")
        d = d.groupBy(*by, "i", "li", "lj").agg(F.avg("w").alias("m"))
    else:
        d = both.join(lab.select(F.col("id").alias("j"), F.col("label").alias("lj")), "j").groupBy("i", "lj").agg(F.avg("w").alias("m"))
        d = d.join(lab.select(F.col("id").alias("i"), F.col("label").alias("li")), "i")
    ab = d.groupBy(*by, "i").agg(F.max(F.when(F.col("li") == F.col("lj"), F.col("m"))).alias("a"), F.min(F.when(F.col("li") != F.col("lj"), F.col("m"))).alias("b"))
    out = lab.join(size, [*by, "label"]).join(ab.withColumnRenamed("i", "id"), [*by, "id"], "left")
    s = F.when((F.col("n") == 1) | F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return out.select(*by, "id", "label", F.round(s, 6).alias("s"))


def silhouette_means(both: DataFrame, named: DataFrame, levels: list[int]) -> DataFrame:
    """``level, silhouette``: mean of ``silhouettes`` at each of ``levels`` from ``id, labels``, the clusters at them in order; no rows without samples.

    The pairs of a sample come sorted behind its own labels and are added up where
    they are read, so they are moved twice and never listed by level. A task holds
    the pairs of one sample at a time besides a batch.
    """
    named = named.where("id is not null")
    n = named.count()
    theirs = both.join(named.select(F.col("id").alias("j"), "labels"), "j").select("i", F.lit(1).alias("k"), F.col("w").cast("double").alias("w"), "labels")
    own = named.select(F.col("id").alias("i"), F.lit(0).alias("k"), F.lit(0.0).alias("w"), "labels")

    def means(t: pa.Table) -> pa.RecordBatch:
        i, k, w = (t[c].to_numpy() for c in ("i", "k", "w"))
        labels = t["labels"].combine_chunks().flatten().to_numpy().reshape(len(i), -1)
        new = np.concatenate([[True], np.diff(i) != 0])
        first, group = np.nonzero(new)[0], np.cumsum(new) - 1
        listed = np.bincount(group[k == 0], minlength=len(first))  # a sample listed twice counts twice
        row = np.nonzero((k == 1) & (listed[group] > 0))[0]
        g, w = group[row], w[row]
        found = []
        for p in range(labels.shape[1]):
            theirs, mine = labels[row, p], labels[first[g], p]
            inside = theirs == mine
            count = np.bincount(g[inside], minlength=len(first))
            a = np.bincount(g[inside], w[inside], minlength=len(first)) / np.maximum(count, 1)
            out = np.nonzero(~inside & (count[g] > 0))[0]
            if not len(out):
                continue
            out = out[np.lexsort((theirs[out], g[out]))]
            start = np.nonzero(np.concatenate([[True], (np.diff(g[out]) != 0) | (np.diff(theirs[out]) != 0)]))[0]
            mean = np.add.reduceat(w[out], start) / np.diff(np.append(start, len(out)))
            near = g[out][start]
            at = np.nonzero(np.concatenate([[True], np.diff(near) != 0]))[0]
            found.append((np.full(len(at), p), listed[near[at]], a[near[at]], np.minimum.reduceat(mean, at)))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.array([], x) for x in (np.int64, np.int64, float, float)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["p", "c", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            i = t["i"].to_numpy()
            if held and (held[-1]["i"][-1].as_py() != i[0] or i[0] != i[-1]):
                cut = int(np.searchsorted(i, i[-1]))  # the last sample may go on in the next batch
                if cut:
                    held.append(t.slice(0, cut))
                yield means(pa.concat_tables(held))
                held, t = [], t.slice(cut)
            held.append(t)
        if held:
            yield means(pa.concat_tables(held))

    per = theirs.unionByName(own).repartition("i").sortWithinPartitions("i", "k").mapInArrow(run, "p bigint, c bigint, a double, b double")
    top = F.greatest("a", "b")
    s = F.round(F.when(top == 0, 0.0).otherwise((F.col("b") - F.col("a")) / top), 6)  # 0 for all samples without pairs inside or outside
    sums = dict(per.groupBy("p").agg(F.sum(s * F.col("c"))).collect())  # at most one row per level
    return named.sparkSession.createDataFrame([(d, sums.get(p, 0.0) / n) for p, d in enumerate(levels)] if n else [], "level int, silhouette double").select("level", F.round("silhouette", 6).alias("silhouette"))


def mutual_information(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``nmi``: information shared by two labelings (id, label), over the mean entropy, held within [0, 0.999]."""
    pair = a.select("id", F.col("label").alias("u")).join(b.select("id", F.col("label").alias("v")), "id")
    cell = pair.groupBy("u", "v").agg(F.count("*").cast("double").alias("c"))
    rows, cols = Window.partitionBy("u"), Window.partitionBy("v")
    cell = cell.withColumn("cu", F.sum("c").over(rows)).withColumn("cv", F.sum("c").over(cols))
    t = cell.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log(F.col("c") / (F.col("cu") * F.col("cv")))).alias("joint"), F.sum(F.col("c") * F.log("cu")).alias("hu"), F.sum(F.col("c") * F.log("cv")).alias("hv"))
    mi = F.col("joint") / F.col("n") + F.log("n")
    h = (2 * F.log("n") - (F.col("hu") + F.col("hv")) / F.col("n")) / 2
    return t.select(F.round(F.least(F.greatest(F.when(h <= 0, 1.0).otherwise(mi / h), F.lit(0.0)), F.lit(0.999)), 6).alias("nmi"))


def nested_information(levels: DataFrame) -> DataFrame:
    """``level1, level2, nmi`` of every two levels of a hierarchy (id, level, cluster), level1 below level2.

    A cluster lies inside one cluster of each level above, so two levels share the
    whole entropy of the upper one and only the cluster sizes are needed.
    """
    return _shared(levels.groupBy("level", "cluster").agg(F.count("*").cast("double").alias("c")))


def named_information(named: DataFrame, levels: list[int]) -> DataFrame:
    """``nested_information`` of ``id, labels``, the clusters at ``levels`` in order."""
    size = named.select(F.posexplode("labels").alias("p", "cluster")).groupBy("p", "cluster").agg(F.count("*").cast("double").alias("c"))
    return _shared(size.withColumn("level", F.element_at(F.array(*[F.lit(d) for d in levels]), F.col("p") + 1)))


def _shared(size: DataFrame) -> DataFrame:
    """``nested_information`` from the sizes: ``level, cluster, c``."""
    h = size.groupBy("level").agg((F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")).alias("h"))  # one row per level
    return _paired(pin(h, "entropy"))


def summed_information(spark: SparkSession, n: int, sums: list[float], levels: list[int]) -> DataFrame:
    """``nested_information`` from the number of samples and, at each of ``levels``, the sum of c ln c over the sizes of the clusters."""
    return _paired(spark.createDataFrame([(d, float(np.log(n) - s / n)) for d, s in zip(levels, sums, strict=True)] if n else [], "level int, h double"))


def _paired(h: DataFrame) -> DataFrame:
    """``nested_information`` from the entropies: ``level, h``, one row per level."""
    h = h.select("level", F.when(F.col("h") > 1e-12, F.col("h")).otherwise(0.0).alias("h"))
    pair = h.select(F.col("level").alias("level1"), F.col("h").alias("h1")).join(F.broadcast(h.select(F.col("level").alias("level2"), F.col("h").alias("h2"))), F.col("level1") < F.col("level2"))
    nmi = F.when(F.col("h1") + F.col("h2") <= 0, 1.0).otherwise(2 * F.col("h2") / (F.col("h1") + F.col("h2")))
    return pair.select("level1", "level2", F.round(F.least(F.greatest(nmi, F.lit(0.0)), F.lit(0.999)), 6).alias("nmi"))


def davies_bouldin(profiles: DataFrame, labels: DataFrame) -> DataFrame:
    """One row ``db``: samples as rows of presence-coded loci, centroids per label, in long form.

    ``profiles``: id, k, x (long). Cluster pairs are compared over shared loci;
    the number of labels should be small against the samples.
    """
    return davies_bouldin_of(profiles.join(labels, "id"))


def davies_bouldin_of(x: DataFrame) -> DataFrame:
    """``davies_bouldin`` of rows ``id, label, k, x``, where each value carries its label already."""
    x = x.where("label is not null and k is not null")
    mu = pin(x.groupBy("label", "k").agg(F.avg("x").alias("m")), "centres")  # a row per label and locus
    spread = x.join(mu, ["label", "k"]).groupBy("label", "id").agg(F.sqrt(F.sum((F.col("x") - F.col("m")) ** 2)).alias("d")).groupBy("label").agg(F.avg("d").alias("s"))
    spread = pin(spread, "spread")
    a, b = mu.select(F.col("label").alias("la"), "k", F.col("m").alias("ma")), mu.select(F.col("label").alias("lb"), "k", F.col("m").alias("mb"))
    gap = a.join(b, "k").where("la <> lb").groupBy("la", "lb").agg(F.sqrt(F.sum((F.col("ma") - F.col("mb")) ** 2)).alias("g"))
    r = gap.join(spread.select(F.col("label").alias("la"), F.col("s").alias("sa")), "la").join(spread.select(F.col("label").alias("lb"), F.col("s").alias("sb")), "lb")
    return r.where("g > 0").groupBy("la").agg(F.max((F.col("sa") + F.col("sb")) / F.col("g")).alias("r")).agg(F.round(F.avg("r"), 6).alias("db"))


def permutation_test(edges: DataFrame, labels: DataFrame, n_permutations: int = 20) -> DataFrame:
    """One row: mean distance inside clusters, its mean and deviation under permuted labels, p and effect size.

    Permutation p gives the k-th sample in the order of md5(id-p) the label of
    the k-th sample by id. Ranks come from range-partitioned numbering, so no
    permutation is tied to one task.
    """
    labels = pin(labels.select("id", "label"), "labels")
    perms = labels.select("id", F.explode(F.sequence(F.lit(1), F.lit(n_permutations))).alias("p")).withColumn("h", F.md5(F.concat_ws("-", "id", "p")))
    shuffled = number_within_key(perms, "p", ["h", "id"]).select("id", "p", "_n")
    ranked = number_within_key(labels.withColumn("one", F.lit(0)), "one", ["id"]).select("_n", "label")
    lab = pin(shuffled.join(ranked, "_n").select("id", "p", "label"), "shuffled")
    stat = lambda df: df.where("lu = lv").groupBy("p").agg(F.avg("w").alias("m"))
    null = stat(edges.join(lab.select(F.col("id").alias("u"), "p", F.col("label").alias("lu")), "u").join(lab.select(F.col("id").alias("v"), "p", F.col("label").alias("lv")), ["v", "p"]))
    one = labels.withColumn("p", F.lit(0))
    real = stat(edges.join(one.select(F.col("id").alias("u"), "p", F.col("label").alias("lu")), "u").join(one.select(F.col("id").alias("v"), F.col("label").alias("lv")), "v"))
    t = null.crossJoin(F.broadcast(real.select(F.col("m").alias("real"))))  # one row
    return t.groupBy("real").agg(F.avg("m").alias("null_mean"), F.stddev_pop("m").alias("null_std"), F.avg((F.col("m") <= F.col("real")).cast("double")).alias("p_value")).select(
        F.round("real", 6).alias("real"), F.round("null_mean", 6).alias("null_mean"), F.round("null_std", 6).alias("null_std"), F.round("p_value", 6).alias("p_value"), F.round((F.col("real") - F.col("null_mean")) / F.nullif(F.col("null_std"), F.lit(0.0)), 4).alias("effect")
    )
