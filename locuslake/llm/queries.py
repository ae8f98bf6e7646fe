"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profiles import distinct_profiles, load_profiles
from ..plans.core_queries import PLACES_SQL, WS
from ..session import pin, table
from . import canonical, clusters, components, consolidate, leakage, neighbours, packing, privacy

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PAIRS_SQL = """p AS (SELECT sample_idx, [""" + ", ".join(f"greatest(coalesce(l{k}, 0), 0)" for k in range(1, 65)) + """] AS a FROM cgmlst_profile),
q AS (SELECT *, len(list_filter(a, lambda x: x > 0))::DOUBLE AS n FROM p),
z AS (SELECT x.sample_idx AS i, y.sample_idx AS j, greatest(x.n, y.n) - 0.05::DOUBLE * 64 AS ll, list_zip(x.a, y.a) AS z FROM q x JOIN q y ON x.sample_idx < y.sample_idx),
c AS (SELECT i, j, ll, len(list_filter(z, lambda x: x[1] > 0 AND x[2] > 0))::DOUBLE + 1e-12 AS al, len(list_filter(z, lambda x: x[1] > 0 AND x[2] > 0 AND x[1] <> x[2]))::DOUBLE AS ad FROM z),
d AS (SELECT i, j, floor((ad + greatest(ll - al, 0)) / (al + greatest(ll - al, 0)) * 64 + 0.5)::INT AS d0 FROM c)"""

# 1 - most similar vectors


@query()
def p1_found(spark, sf_dir):
    """Pairs of samples of which one is among the other's 5 nearest, at d0 <= 12."""
    return neighbours.close_pairs(neighbours.nearest_samples(load_profiles(spark, sf_dir)), 12)


@query()
def p1_nearest(spark, sf_dir):
    """The 5 nearest samples of every sample."""
    return neighbours.nearest_samples(load_profiles(spark, sf_dir))


# 2 - similarity clusters


@query(f"""WITH RECURSIVE {PAIRS_SQL}, s AS MATERIALIZED (SELECT i AS a, j AS b FROM d WHERE d0 <= 7 UNION ALL SELECT j, i FROM d WHERE d0 <= 7),
t AS (SELECT a AS sample_idx, a AS cluster_id FROM s UNION SELECT s.b, t.cluster_id FROM t JOIN s ON s.a = t.sample_idx WHERE t.cluster_id < s.b)
SELECT sample_idx, min(cluster_id) AS cluster_id FROM t GROUP BY 1""")
def p2_found(spark, sf_dir):
    """Each sample in a level-7 cluster of two or more, with the cluster's smallest sample."""
    samples = load_profiles(spark, sf_dir)
    distinct = pin(distinct_profiles(samples), "distinct")
    found = clusters.linked_clusters(*clusters.kmeans(distinct), within=7)
    sized = pin(distinct.join(found, "rep").select("alleles", "n", "cluster_id"), "found")
    real = sized.groupBy("cluster_id").agg(F.sum("n").alias("size")).where("size > 1").select("cluster_id")
    return samples.join(sized.join(real, "cluster_id").select("alleles", "cluster_id"), "alleles").select("sample_idx", "cluster_id")


@query()
def p2_clusters(spark, sf_dir):
    """The k-means clusters: size, spread, the three most typical samples."""
    assigned, _ = clusters.kmeans(pin(distinct_profiles(load_profiles(spark, sf_dir)), "distinct"))
    return clusters.describe(pin(assigned, "cells"))


# 4 - consolidating pairwise matches

LINKS_SQL = """WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, list_distinct(list_filter(cluster_to_samples, lambda x: x IS NOT NULL)) AS xs FROM collapse_metadata),
e AS (SELECT i AS a, j AS b FROM dist WHERE d0 BETWEEN 0 AND 7 AND i <> j UNION SELECT list_min(xs), unnest(xs) FROM m WHERE len(xs) > 1),
s AS (SELECT DISTINCT a, b FROM e WHERE a <> b UNION SELECT DISTINCT b, a FROM e WHERE a <> b),
t AS (SELECT a AS sample_idx, a AS group_id FROM s UNION SELECT s.b, t.group_id FROM t JOIN s ON s.a = t.sample_idx WHERE t.group_id < s.b),
g AS (SELECT sample_idx, min(group_id) AS group_id FROM t GROUP BY 1)
"""


def _links(spark, sf_dir):
    close = table(spark, sf_dir, "dist").where("d0 between 0 and 7").select(F.col("i").alias("u"), F.col("j").alias("v"))
    return close.unionByName(components.list_links(table(spark, sf_dir, "collapse_metadata"), "cluster_to_samples"))


@query(LINKS_SQL + "SELECT sample_idx, group_id FROM g")
def p4_found(spark, sf_dir):
    """Samples in a group of two or more, with the group's smallest sample."""
    return components.hash_to_min(_links(spark, sf_dir)).withColumnRenamed("vertex", "sample_idx")


@query(LINKS_SQL + "SELECT p.sample_idx, coalesce(g.group_id, p.sample_idx) AS group_id FROM cgmlst_profile p LEFT JOIN g USING (sample_idx)")
def p4_groups(spark, sf_dir):
    """Every sample of the profile table with its group, alone or not."""
    found = components.hash_to_min(_links(spark, sf_dir))
    samples = table(spark, sf_dir, "cgmlst_profile").select("sample_idx")
    return samples.join(found, F.col("sample_idx") == F.col("vertex"), "left").select("sample_idx", F.coalesce("group_id", "sample_idx").alias("group_id"))


# 5 - one surviving record per group


def _members(spark, sf_dir, extra):
    lists = table(spark, sf_dir, "collapse_metadata").select(F.col("cluster_id").alias("group_id"), F.explode("cluster_to_samples").alias("member")).where("member is not null").distinct()
    samples = load_profiles(spark, sf_dir, ["lab_code", "received_at", *extra]).withColumnRenamed("sample_idx", "member")
    return lists.join(samples, "member").withColumnsRenamed({"lab_code": "source", "received_at": "ts"})


def _trust(spark, sf_dir):
    return table(spark, sf_dir, "labs").select(F.col("lab_code").alias("source"), F.col("trust_rank").alias("rank"))


def _fields(loci):
    said = {c: F.when(consolidate.known_text(F.col(c)), F.col(c)) for c in ("country", "name")}
    return said | {f"l{k}": F.nullif(F.element_at("alleles", k), F.lit(0)) for k in loci}


@query("""WITH m AS (SELECT DISTINCT cluster_id, unnest(cluster_to_samples) AS sample_idx FROM collapse_metadata),
p AS (SELECT m.cluster_id, p.sample_idx, coalesce(l.trust_rank, 1000) AS r, p.received_at, p.country, p.name, p.l1 FROM m JOIN cgmlst_profile p USING (sample_idx) LEFT JOIN labs l USING (lab_code)),
f AS (SELECT *, 'country' AS field_name, country AS v FROM p UNION ALL SELECT *, 'name', name FROM p UNION ALL SELECT *, 'l1', CASE WHEN l1 > 0 THEN 'x' || l1 END FROM p)
SELECT cluster_id, field_name, sample_idx FROM f
WHERE regexp_matches(v, '\\p{L}') AND regexp_replace(lower(v), '[^\\p{L}\\p{Nd}]', '', 'g') NOT IN ('na','nan','nil','none','null','unknown','unk','missing','tbd','tba','tbc','notknown','notprovided','notavailable','notapplicable','notcollected','notgiven','notspecified','notreported','notdetermined','nodata','undefined','undetermined','unspecified','unavailable','empty','blank','noname','nd','xxx')
QUALIFY row_number() OVER (PARTITION BY cluster_id, field_name ORDER BY r, received_at DESC NULLS LAST, sample_idx) = 1""")
def p5_found(spark, sf_dir):
    """The listed sample that each of three fields comes from."""
    claims = consolidate.claims_from_members(_members(spark, sf_dir, ["country", "name"]), _fields([1]))
    truth = consolidate.first_claims(claims, _trust(spark, sf_dir))
    return truth.select(F.col("group_id").alias("cluster_id"), "field_name", F.col("member").alias("sample_idx"))


@query()
def p5_consensus(spark, sf_dir):
    """The surviving profile of each cluster by weighted votes: name, country and every locus."""
    claims = consolidate.claims_from_members(_members(spark, sf_dir, ["country", "name"]), _fields(range(1, 65)))
    truth, _ = consolidate.discover_truth(claims, vote="sum")
    best = lambda f: F.max(F.when(F.col("field_name") == f, F.col("value")))
    loci = F.array(*[F.coalesce(best(f"l{k}").cast("int"), F.lit(0)) for k in range(1, 65)])
    return truth.groupBy(F.col("group_id").alias("cluster_id")).agg(best("name").alias("name"), best("country").alias("country"), loci.alias("alleles"), F.sum("support").alias("support"))


# 7 - duplicates hidden by formatting


def _encoded(spark, sf_dir):
    return canonical.encode_records(table(spark, sf_dir, "cgmlst_tokens"), "raw_id", "st", "cgmlst")


RECORDS_SQL = (
    PLACES_SQL
    + r""", v AS (SELECT raw_id, CASE WHEN regexp_full_match(token, '[Ll][0-9]{1,18}[:=].*') THEN regexp_extract(token, '^[Ll]([0-9]{1,18})', 1)::BIGINT ELSE pos END AS locus,
lower(regexp_replace(CASE WHEN regexp_full_match(token, '[Ll][0-9]{1,18}[:=].*') THEN regexp_extract(token, '^[Ll][0-9]{1,18}[:=](.*)$', 1) ELSE token END, '[^\p{L}\p{Nd}]', '', 'g')) AS v FROM places),
r AS (SELECT raw_id, string_agg(DISTINCT locus || ':' || v, ',' ORDER BY locus || ':' || v) AS r FROM v WHERE v <> '' GROUP BY 1),
a AS (SELECT c.raw_id, CASE WHEN c.st IS NULL OR c.cgmlst IS NULL OR regexp_full_match(c.cgmlst, '"""
    + WS
    + r"""*') THEN NULL ELSE regexp_replace(c.st, '[^0-9]', '', 'g') || '|' || coalesce(r.r, '') END AS k FROM cgmlst_tokens c LEFT JOIN r USING (raw_id)),
g AS (SELECT raw_id, CASE WHEN k IS NULL THEN raw_id ELSE min(raw_id) OVER (PARTITION BY k) END AS keep_id, k FROM a)
"""
)


@query(RECORDS_SQL + "SELECT keep_id, raw_id FROM g WHERE raw_id <> keep_id")
def p7_found(spark, sf_dir):
    """Every copy of a record but the first, with the first."""
    return _encoded(spark, sf_dir).where("raw_id <> first_id").select(F.col("first_id").alias("keep_id"), "raw_id")


@query(RECORDS_SQL + ", m AS (SELECT raw_id, count(DISTINCT locus || ':' || v) AS n FROM v WHERE v <> '' GROUP BY 1) SELECT keep_id, count(*) AS n_copies, max(CASE WHEN k IS NOT NULL THEN coalesce(m.n, 0) END)::INT AS n_values FROM g LEFT JOIN m USING (raw_id) GROUP BY 1")
def p7_records(spark, sf_dir):
    """One row per record: its first row, its copies, its number of coded values."""
    e = _encoded(spark, sf_dir)
    return e.groupBy(F.col("first_id").alias("keep_id")).agg(F.count("*").alias("n_copies"), F.max(F.size("tuple.pairs")).alias("n_values"))


# 8 - filling containers with texts

CAPACITY = 2048


def _packed(spark, sf_dir):
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), "doc_id", "text", CAPACITY), CAPACITY)


@query()
def p8_containers(spark, sf_dir):
    """The container of every text, or of every piece of a text longer than a container."""
    return _packed(spark, sf_dir)[0]


@query()
def p8_report(spark, sf_dir):
    """Containers, lower bound and fill of each group of texts."""
    placed, report = _packed(spark, sf_dir)
    return report.withColumn("fill_share", F.round(F.col("filled") / (F.col("containers") * CAPACITY), 6))


# 9 - evaluation texts in training text


@query()
def p9_found(spark, sf_dir):
    """Documents that hold 12 consecutive words of an evaluation item."""
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


@query()
def p9_near(spark, sf_dir):
    """The same with one word edited."""
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), max_edits=1)


# 10 - personal information


@query()
def p10_found(spark, sf_dir):
    """Kind and first character of every piece of personal information."""
    return privacy.find_personal(table(spark, sf_dir, "documents")).select("doc_id", "kind", "start_pos")


@query()
def p10_redacted(spark, sf_dir):
    """Every text with typed placeholders in place of personal information."""
    return privacy.find_personal(table(spark, sf_dir, "documents"), redact=True)
