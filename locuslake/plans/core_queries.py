"""Registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.text import organism_key
from ..operators import cluster, distance, evaluate, graph, hotkeys, packed, pairs, series
from ..operators.profiles import load_profiles, present
from ..session import pin, table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ORG_KEY_SQL = r"coalesce(nullif(regexp_replace(organismid, '^[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+|[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+$', '', 'g'), ''), 'unknown')"


def _organism_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "cgmlst_supp_species").select(organism_key(F.col("organismid")).alias("organism_key"), "sample_idx", "uploader", "loaded_at", "row_id")
    return hotkeys.chunked_key_stats(rows, "organism_key", "sample_idx", "loaded_at", members="uploader", tie="row_id")


@query(f"""SELECT organism_key FROM (SELECT {ORG_KEY_SQL} AS organism_key, count(*) AS n FROM cgmlst_supp_species GROUP BY 1)
WHERE n >= 0.03 * (SELECT count(*) FROM cgmlst_supp_species)""")
def p3_found(spark, sf_dir):
    """Keys with at least 3 % of the rows, from the chunked per-key result."""
    return hotkeys.heavy_keys(_organism_stats(spark, sf_dir), "organism_key", 0.03)


@query(f"""SELECT {ORG_KEY_SQL} AS organism_key, count(*) AS n_rows, count(DISTINCT sample_idx) AS n_samples, count(DISTINCT uploader) AS n_uploaders,
epoch_us(max(loaded_at)) AS latest_us FROM cgmlst_supp_species GROUP BY 1""")
def p3_key_stats(spark, sf_dir):
    """Rows, samples, uploaders and latest load of every organism key."""
    s = _organism_stats(spark, sf_dir)
    return s.select("organism_key", "n_rows", F.col("n_sample_idx").alias("n_samples"), F.col("n_uploader").alias("n_uploaders"), F.unix_micros(F.col("latest").cast("timestamp")).alias("latest_us"))


#: places of the packed field, up to ``places``: raw_id, pos, token; lexemes in order, a run of white space beside another separator means nothing
WS = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
QUOTED, BARE = '"(?:[^"]|"")*"|' + "''(?:[^'']|'''')*''", r"[\p{L}\p{N}~.:=-]+"
PLACES_SQL = f"""WITH f AS (SELECT raw_id, regexp_replace(cgmlst, '^{WS}+|{WS}+$', '', 'g') AS f FROM cgmlst_tokens WHERE cgmlst IS NOT NULL),
x AS (SELECT raw_id, regexp_extract_all(f, '(?s){QUOTED}|{BARE}|{WS}+|.') AS x FROM f), l AS (SELECT raw_id, unnest(x) AS l, unnest(range(1, len(x) + 1)) AS o FROM x),
k AS (SELECT *, CASE WHEN regexp_full_match(l, '(?s){QUOTED}') THEN 'q' WHEN regexp_full_match(l, '{BARE}') THEN 'b' WHEN regexp_full_match(l, '{WS}+') THEN 'w' ELSE 'o' END AS kind FROM l),
n AS (SELECT *, lag(kind) OVER w AS pk, lead(kind) OVER w AS nk FROM k WINDOW w AS (PARTITION BY raw_id ORDER BY o)),
s AS (SELECT *, 1 + sum(CASE WHEN kind = 'o' OR (kind = 'w' AND pk <> 'o' AND nk <> 'o') THEN 1 ELSE 0 END) OVER (PARTITION BY raw_id ORDER BY o) AS pos FROM n),
places AS (SELECT raw_id, pos::INT AS pos, string_agg(CASE WHEN kind = 'q' THEN replace(substr(l, 2, len(l) - 2), l[1] || l[1], l[1]) ELSE l END, '' ORDER BY o) AS token FROM s WHERE kind IN ('q', 'b') GROUP BY 1, 2)
"""


@query(PLACES_SQL + r"SELECT raw_id, pos, token FROM places WHERE regexp_matches(token, '[\p{L}\p{Nd}]')")
def p6_found(spark, sf_dir):
    """Allele tokens of the packed field with their places."""
    places = packed.split_packed(table(spark, sf_dir, "cgmlst_tokens"), "cgmlst", ["raw_id"])
    return places.where(F.col("token").rlike(r"[\p{L}\p{Nd}]")).select("raw_id", "pos", "token")


@query()
def p6_places(spark, sf_dir):
    """Every place, empty ones too, with its kind and whether a quote before it was malformed; brackets group."""
    return packed.split_packed(table(spark, sf_dir, "cgmlst_tokens"), "cgmlst", ["raw_id"], brackets="[](){}")


# profiles

ALLELES_SQL = "[" + ", ".join(f"greatest(coalesce(l{k}, 0), 0)" for k in range(1, 65)) + "]"


@query(f"""SELECT sample_idx, len(list_filter(a, lambda x: x > 0)) AS n_present, list_sum(a)::BIGINT AS allele_sum FROM (SELECT sample_idx, {ALLELES_SQL} AS a FROM cgmlst_profile)""")
def profile_encode(spark, sf_dir):
    """Encoded profiles: loci present and sum of codes."""
    p = load_profiles(spark, sf_dir)
    return p.select("sample_idx", present(F.col("alleles")).cast("long").alias("n_present"), F.aggregate("alleles", F.lit(0).cast("long"), lambda s, x: s + x).alias("allele_sum"))


@query(f"""SELECT sample_idx, 64 - len(list_filter(a, lambda x: x > 0)) AS absent, row_number() OVER (ORDER BY 64 - len(list_filter(a, lambda x: x > 0)), sample_idx) AS proc_rank
FROM (SELECT sample_idx, {ALLELES_SQL} AS a FROM cgmlst_profile)""")
def missing_rank(spark, sf_dir):
    """Processing order: fewest absent loci first, numbered without a single-task sort."""
    p = load_profiles(spark, sf_dir).select("sample_idx", (64 - present(F.col("alleles"))).cast("long").alias("absent"), F.lit(0).alias("one"))
    return hotkeys.number_within_key(p, "one", ["absent", "sample_idx"]).select("sample_idx", "absent", (F.col("_n") + 1).alias("proc_rank"))


@query("SELECT st, count(*) AS n FROM cgmlst_profile WHERE st > 0 GROUP BY st")
def st_value_counts(spark, sf_dir):
    return table(spark, sf_dir, "cgmlst_profile").where("st > 0").groupBy("st").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE st IS NULL) AS n_null, count(*) FILTER (WHERE st <= 0) AS n_nonpositive, count(DISTINCT st) FILTER (WHERE st > 0) AS n_st FROM cgmlst_profile")
def st_report(spark, sf_dir):
    """Identifiers dropped by the positive rule, counted."""
    return table(spark, sf_dir, "cgmlst_profile").agg(F.count("*").alias("n_rows"), F.count_if(F.col("st").isNull()).alias("n_null"), F.count_if(F.col("st") <= 0).alias("n_nonpositive"), F.count_distinct(F.when(F.col("st") > 0, F.col("st"))).alias("n_st"))


@query("SELECT st, min(sample_idx) AS sample_idx, arg_min(coalesce(lab_code, ''), sample_idx) AS lab_code FROM cgmlst_profile WHERE st > 0 GROUP BY st")
def keep_first_dedup(spark, sf_dir):
    """First row of every identifier, in sample order."""
    p = table(spark, sf_dir, "cgmlst_profile").where("st > 0")
    return p.groupBy("st").agg(F.min("sample_idx").alias("sample_idx"), F.min_by(F.coalesce("lab_code", F.lit("")), "sample_idx").alias("lab_code"))


@query(f"""SELECT min(sample_idx) AS rep, count(*) AS n, count(DISTINCT st) AS n_st FROM (SELECT sample_idx, st, {ALLELES_SQL} AS a FROM cgmlst_profile) GROUP BY a""")
def hc0_dedup(spark, sf_dir):
    """Equal profiles as one, with multiplicities."""
    return load_profiles(spark, sf_dir, ["st"]).groupBy("alleles").agg(F.min("sample_idx").alias("rep"), F.count("*").alias("n"), F.count_distinct("st").alias("n_st")).drop("alleles")


@query("""SELECT k, count(*) FILTER (WHERE a > 0) AS n_present, count(DISTINCT a) FILTER (WHERE a > 0) AS n_alleles, max(a) AS max_allele
FROM (SELECT unnest(range(1, 65)) AS k, unnest(""" + ALLELES_SQL + """) AS a FROM cgmlst_profile) GROUP BY k""")
def locus_summary(spark, sf_dir):
    """Per locus: presence, number of alleles, largest code (the long form of the profile matrix)."""
    long = load_profiles(spark, sf_dir).select(F.posexplode("alleles").alias("pos", "a"))
    return long.groupBy((F.col("pos") + 1).cast("long").alias("k")).agg(F.count_if(F.col("a") > 0).alias("n_present"), F.count_distinct(F.when(F.col("a") > 0, F.col("a"))).alias("n_alleles"), F.max("a").alias("max_allele"))


@query("SELECT loci.locus, count(*) FILTER (WHERE p.a > 0) AS n FROM (SELECT unnest(range(1, 65)) AS k, unnest(" + ALLELES_SQL + ") AS a FROM cgmlst_profile) p JOIN loci ON loci.k = p.k GROUP BY 1")
def locus_join(spark, sf_dir):
    """Presence by locus name."""
    long = load_profiles(spark, sf_dir).select(F.posexplode("alleles").alias("pos", "a")).groupBy((F.col("pos") + 1).alias("k")).agg(F.count_if(F.col("a") > 0).alias("n"))
    return long.join(table(spark, sf_dir, "loci"), "k").select("locus", "n")


# token strings

TOK_SQL = "string_split(replace(coalesce(cgmlst, ''), ',', '_'), '_')"


@query(f"SELECT raw_id, unnest(range(1, len(t) + 1)) AS k, unnest(t) AS token FROM (SELECT raw_id, {TOK_SQL} AS t FROM cgmlst_tokens)")
def token_split(spark, sf_dir):
    """Comma and underscore separated tokens as one row each."""
    t = table(spark, sf_dir, "cgmlst_tokens").select("raw_id", F.posexplode(tokens.split_tokens(F.col("cgmlst"))).alias("pos", "token"))
    return t.select("raw_id", (F.col("pos") + 1).cast("long").alias("k"), "token")


@query(f"""SELECT raw_id, len(t) AS n_tokens, (SELECT max(len({TOK_SQL})) FROM cgmlst_tokens) AS width, (SELECT max(len({TOK_SQL})) FROM cgmlst_tokens) - len(t) AS n_padded FROM (SELECT raw_id, {TOK_SQL} AS t FROM cgmlst_tokens)""")
def token_pad(spark, sf_dir):
    """Ragged token lists filled to the widest."""
    t = table(spark, sf_dir, "cgmlst_tokens").select("raw_id", tokens.split_tokens(F.col("cgmlst")).alias("t"))
    w = F.broadcast(t.agg(F.max(F.size("t")).alias("width")))  # one row
    p = t.crossJoin(w).withColumn("p", tokens.pad(F.col("t"), F.col("width")))
    return p.select("raw_id", F.size("t").cast("long").alias("n_tokens"), F.size("p").cast("long").alias("width"), (F.size("p") - F.size("t")).cast("long").alias("n_padded"))


@query(f"""SELECT token, CASE WHEN s IN ('', '_', 'nan') THEN NULL WHEN regexp_full_match(s, '[0-9]{{1,18}}') THEN s::BIGINT
WHEN regexp_full_match(s, '[0-9a-f]{{8,}}') THEN ((('0x' || substr(s, 1, 16))::UBIGINT) % 2147483647)::BIGINT
ELSE ((('0x' || substr(md5(s), 1, 15))::UBIGINT) % 2147483647)::BIGINT END AS code
FROM (SELECT DISTINCT token, lower(trim(token)) AS s FROM (SELECT unnest({TOK_SQL}) AS token FROM cgmlst_tokens))""")
def token_to_int(spark, sf_dir):
    """Integer of every distinct token: digits, hexadecimal prefix, or a stable hash."""
    t = table(spark, sf_dir, "cgmlst_tokens").select(F.explode(tokens.split_tokens(F.col("cgmlst"))).alias("token")).distinct()
    return t.select("token", tokens.token_to_int(F.col("token")).alias("code"))


@query(f"""WITH t AS (SELECT DISTINCT trim(token) AS token FROM (SELECT unnest({TOK_SQL}) AS token FROM cgmlst_tokens)),
n AS (SELECT token, CASE WHEN token IN ('', '0') OR token LIKE '-%' THEN 0 WHEN regexp_full_match(token, '[0-9]{{1,10}}') AND token::BIGINT <= 1000000000 THEN token::BIGINT END AS v FROM t)
SELECT token, coalesce(v, (SELECT max(v) FROM n) + row_number() OVER (PARTITION BY v IS NULL ORDER BY encode(token))) AS code FROM n""")
def dict_code(spark, sf_dir):
    """One dictionary over all loci: numbers keep their value, other tokens follow in sorted order."""
    t = table(spark, sf_dir, "cgmlst_tokens").select(F.explode(tokens.split_tokens(F.col("cgmlst"))).alias("token")).select(F.trim("token").alias("token")).distinct()
    n = t.withColumn("v", tokens.numeric_allele(F.col("token")))
    top = F.broadcast(n.agg(F.max("v").alias("top")))  # one row
    rest = hotkeys.number_within_key(n.where("v is null").select("token", F.lit(0).alias("one")), "one", ["token"]).crossJoin(top)
    return n.where("v is not null").select("token", F.col("v").alias("code")).unionByName(rest.select("token", (F.col("top") + F.col("_n") + 1).alias("code")))


@query("SELECT checksum, min(raw_id) AS raw_id, count(*) AS n FROM cgmlst_tokens GROUP BY checksum")
def checksum_dedup(spark, sf_dir):
    """First row of every checksum."""
    return table(spark, sf_dir, "cgmlst_tokens").groupBy("checksum").agg(F.min("raw_id").alias("raw_id"), F.count("*").alias("n"))


@query(r"SELECT sample_idx, regexp_replace(trim(name), '^#+', '') AS clean_id, CASE WHEN regexp_extract(trim(name), '([0-9]{1,18})$', 1) <> '' THEN regexp_extract(trim(name), '([0-9]{1,18})$', 1)::BIGINT END AS suffix FROM cgmlst_profile WHERE name IS NOT NULL")
def name_parts(spark, sf_dir):
    """Cleaned identifier and number at the end of every name."""
    return table(spark, sf_dir, "cgmlst_profile").where("name is not null").select("sample_idx", tokens.clean_id(F.col("name")).alias("clean_id"), tokens.numeric_suffix(F.col("name")).alias("suffix"))


SAFE_SQL = r"substr(regexp_replace(regexp_replace(regexp_replace(trim(KEY), '[\s/\\]+', '_', 'g'), '[^0-9A-Za-z_.-]', '_', 'g'), '_+', '_', 'g'), 1, 200)"


@query(f"SELECT {SAFE_SQL.replace('KEY', 'k')} AS folder, count(*) AS n FROM (SELECT {ORG_KEY_SQL} AS k FROM cgmlst_supp_species) GROUP BY 1")
def split_counts(spark, sf_dir):
    """Rows per folder of the split by organism."""
    k = organism_key(F.col("organismid"))
    return table(spark, sf_dir, "cgmlst_supp_species").groupBy(tokens.safe_name(k).alias("folder")).agg(F.count("*").alias("n"))


@query("""SELECT coalesce(l.lab_name, 'NA') AS lab, count(*) AS n FROM cgmlst_profile p LEFT JOIN labs l USING (lab_code) GROUP BY 1""")
def label_join_default(spark, sf_dir):
    """Left join to a label table with a default."""
    labs = table(spark, sf_dir, "labs").select("lab_code", "lab_name")
    return table(spark, sf_dir, "cgmlst_profile").join(labs, "lab_code", "left").groupBy(F.coalesce("lab_name", F.lit("NA")).alias("lab")).agg(F.count("*").alias("n"))


@query("""SELECT country, n FROM (SELECT coalesce(country, 'NA') AS country, count(*) AS n, min(sample_idx) AS f FROM cgmlst_profile GROUP BY 1 ORDER BY n DESC, f LIMIT 10) WHERE country <> 'NA'""")
def top_labels(spark, sf_dir):
    """Ten most frequent labels, ties by first seen; the default is removed after the cut."""
    g = table(spark, sf_dir, "cgmlst_profile").groupBy(F.coalesce("country", F.lit("NA")).alias("country")).agg(F.count("*").alias("n"), F.min("sample_idx").alias("f"))
    return g.orderBy(F.desc("n"), "f").limit(10).where("country <> 'NA'").select("country", "n")


@query("""SELECT s.row_id, s.sample_idx, p.st FROM cgmlst_supp_species s JOIN cgmlst_profile p USING (sample_idx) WHERE p.st > 0 AND s.n_loci >= 60""")
def submission_join(spark, sf_dir):
    """Submissions with the identifier of their sample."""
    p = table(spark, sf_dir, "cgmlst_profile").where("st > 0").select("sample_idx", "st")
    return table(spark, sf_dir, "cgmlst_supp_species").where("n_loci >= 60").select("row_id", "sample_idx").join(p, "sample_idx").select("row_id", "sample_idx", "st")


@query("""SELECT t.checksum, count(*) AS n FROM cgmlst_supp_species s JOIN (SELECT DISTINCT checksum FROM cgmlst_tokens) t USING (checksum) GROUP BY 1""")
def checksum_semi(spark, sf_dir):
    """Submissions whose checksum is among the raw records."""
    t = table(spark, sf_dir, "cgmlst_tokens").select("checksum")
    return table(spark, sf_dir, "cgmlst_supp_species").join(t, "checksum", "left_semi").groupBy("checksum").agg(F.count("*").alias("n"))


@query("""SELECT p.sample_idx FROM cgmlst_profile p WHERE NOT EXISTS (SELECT 1 FROM dist d WHERE d.i = p.sample_idx OR d.j = p.sample_idx)""")
def samples_without_pairs(spark, sf_dir):
    """Samples in no compared pair."""
    d = table(spark, sf_dir, "dist").select(F.explode(F.array("i", "j")).alias("sample_idx"))
    return table(spark, sf_dir, "cgmlst_profile").select("sample_idx").join(d, "sample_idx", "left_anti")


# distances

PAIR_SQL = f"""WITH p AS (SELECT sample_idx, {ALLELES_SQL} AS a FROM cgmlst_profile), d AS (SELECT DISTINCT i, j FROM dist WHERE i <> j),
z AS (SELECT d.i, d.j, len(list_filter(list_zip(a.a, b.a), lambda x: x[1] > 0 AND x[2] > 0))::DOUBLE + 1e-12 AS al, len(list_filter(list_zip(a.a, b.a), lambda x: x[1] > 0 AND x[2] > 0 AND x[1] <> x[2]))::DOUBLE AS ad,
len(list_filter(a.a, lambda x: x > 0))::DOUBLE AS ql, len(list_filter(b.a, lambda x: x > 0))::DOUBLE AS rl FROM d JOIN p a ON a.sample_idx = d.i JOIN p b ON b.sample_idx = d.j),
c AS (SELECT *, greatest(greatest(ql, rl) - 0.05::DOUBLE * 64 - al, 0) AS p0, greatest(ql - 0.05::DOUBLE * 64 - al, 0) AS p1 FROM z)"""


@query(PAIR_SQL + " SELECT i, j, floor((ad + p0) / (al + p0) * 64 + 0.5)::INT AS d0, floor((ad + p1) / (al + p1) * 64 + 0.5)::INT AS d1 FROM c")
def dual_distance(spark, sf_dir):
    """Both distances of every listed pair, computed from the profiles."""
    pairs = table(spark, sf_dir, "dist").where("i <> j").select("i", "j").distinct()
    return distance.pair_distances(pairs, load_profiles(spark, sf_dir), 64).select("i", "j", "d0", "d1")


@query(PAIR_SQL + " SELECT i, j, floor(-ln(1 - (ad + 0.5) / (al - 1e-12 + 1.0)) * 64 * 100 + 0.5)::INT AS p FROM c")
def p_distance(spark, sf_dir):
    """Corrected distance of every listed pair."""
    pairs = table(spark, sf_dir, "dist").where("i <> j").select("i", "j").distinct()
    return distance.pair_distances(pairs, load_profiles(spark, sf_dir), 64).select("i", "j", "p")


EDGE_SQL = "e AS (SELECT least(i, j) AS u, greatest(i, j) AS v, min(d0) AS w FROM dist WHERE i <> j AND d0 >= 0 GROUP BY 1, 2)"
BOTH_SQL = EDGE_SQL + ", b AS (SELECT u AS i, v AS j, w FROM e UNION ALL SELECT v, u, w FROM e)"


def _edges(spark, sf_dir):
    return graph.valid_edges(table(spark, sf_dir, "dist"))


def _nodes(spark, sf_dir):
    return table(spark, sf_dir, "cgmlst_profile").select(F.col("sample_idx").alias("id"))


@query(f"WITH {EDGE_SQL} SELECT u, v, w FROM e")
def valid_edges(spark, sf_dir):
    """Undirected pairs with a computed distance, each once."""
    return _edges(spark, sf_dir)


@query(f"WITH {EDGE_SQL} SELECT count(*) AS n, min(w) AS least, max(w) AS most, round(avg(w), 6) AS mean, quantile_cont(w, 0.5)::DOUBLE AS median, round(quantile_cont(w, 0.1), 6)::DOUBLE AS p10, round(quantile_cont(w, 0.9), 6)::DOUBLE AS p90 FROM e")
def distance_summary(spark, sf_dir):
    """Number, range, mean and exact percentiles of the distances."""
    p = lambda q: F.round(F.percentile("w", F.lit(q)), 6)
    return _edges(spark, sf_dir).agg(F.count("*").alias("n"), F.min("w").alias("least"), F.max("w").alias("most"), F.round(F.avg("w"), 6).alias("mean"), p(0.5).alias("median"), p(0.1).alias("p10"), p(0.9).alias("p90"))


@query(f"WITH {BOTH_SQL} SELECT i AS id, round(sum(w) / (count(*) + 1.0), 6)::DOUBLE AS mean_distance FROM b GROUP BY 1")
def row_mean_distance(spark, sf_dir):
    """Mean distance per sample, the sample itself counted with 0."""
    return graph.symmetrised(_edges(spark, sf_dir)).groupBy(F.col("i").alias("id")).agg(F.round(F.sum("w") / (F.count("*") + 1.0), 6).alias("mean_distance"))


@query(f"WITH {EDGE_SQL} SELECT w, count(*) AS n FROM e GROUP BY 1")
def distance_histogram(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy("w").agg(F.count("*").alias("n"))


@query(f"WITH {BOTH_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w, j) AS r FROM b) SELECT DISTINCT least(i, j) AS u, greatest(i, j) AS v, w FROM k WHERE r <= 5")
def knn_edges(spark, sf_dir):
    """Edges among the five nearest of either end."""
    return graph.knn_edges(_edges(spark, sf_dir), 5)


@query(f"WITH {BOTH_SQL} SELECT i AS id, count(*) AS degree FROM b WHERE w <= 7 GROUP BY 1")
def degree(spark, sf_dir):
    """Close neighbours of every sample that has any."""
    return graph.degrees(_edges(spark, sf_dir).where("w <= 7"))


@query(f"WITH {EDGE_SQL} SELECT u, v, w, (100 - w)::BIGINT AS shown FROM e WHERE w > 0 AND w <= 20")
def shown_edges(spark, sf_dir):
    """Edges a drawing shows: neither zero nor longer than the cut."""
    return _edges(spark, sf_dir).where("w > 0 and w <= 20").select("u", "v", "w", (F.lit(100) - F.col("w")).cast("long").alias("shown"))


def _reach(level: str) -> str:
    return f"s AS (SELECT i AS a, j AS b FROM b WHERE {level}), t AS (SELECT a AS id, a AS label FROM s UNION SELECT s.b, t.label FROM t JOIN s ON s.a = t.id WHERE t.label < s.b), g AS (SELECT id, min(label) AS label FROM t GROUP BY 1), n AS (SELECT p.sample_idx AS id, coalesce(g.label, p.sample_idx) AS label FROM cgmlst_profile p LEFT JOIN g ON g.id = p.sample_idx)"


@query(f"WITH RECURSIVE {BOTH_SQL}, {_reach('w <= 7')} SELECT id, label FROM n")
def components_at_7(spark, sf_dir):
    """Single-linkage clusters at distance 7 over the listed pairs."""
    return cluster.labels_at(_edges(spark, sf_dir), _nodes(spark, sf_dir), 7)


@query(f"WITH RECURSIVE {BOTH_SQL}, {_reach('w < 20')} SELECT label, id FROM n WHERE label IN (SELECT label FROM n GROUP BY 1 HAVING count(*) > 1)")
def island_members(spark, sf_dir):
    """Members of every island of short edges, one row each, so that no island has to fit into a list."""
    lab = pin(cluster.labels_at(_edges(spark, sf_dir), _nodes(spark, sf_dir), 20, strict=True), "islands")
    real = lab.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
    return lab.join(real, "label").select("label", "id")


@query(f"""WITH RECURSIVE {BOTH_SQL}, {_reach('w <= 7')}, x AS (SELECT a.label AS la, c.label AS lb FROM e JOIN n a ON a.id = e.u JOIN n c ON c.id = e.v),
z AS (SELECT label, count(*) AS size FROM n GROUP BY 1)
SELECT z.label, size, coalesce(i.c, 0) AS inner_edges, coalesce(o.c, 0) AS outer_edges, CASE WHEN size = 1 THEN 1.0 ELSE round(2.0 * coalesce(i.c, 0) / (size * (size - 1)), 6) END::DOUBLE AS density
FROM z LEFT JOIN (SELECT la AS label, count(*) AS c FROM x WHERE la = lb GROUP BY 1) i USING (label)
LEFT JOIN (SELECT label, count(*) AS c FROM (SELECT la AS label FROM x WHERE la <> lb UNION ALL SELECT lb FROM x WHERE la <> lb) GROUP BY 1) o USING (label)""")
def island_stats(spark, sf_dir):
    """Size, edges and density of the clusters at distance 7."""
    e = pin(_edges(spark, sf_dir), "edges")
    nodes = _nodes(spark, sf_dir)
    return graph.island_stats(e, cluster.labels_at(e, nodes, 7), nodes)


HIER = [0, 3, 7, 12, 20]


@query("WITH RECURSIVE " + BOTH_SQL + ", lv AS (SELECT unnest([0, 3, 7, 12, 20]) AS level), s AS (SELECT level, i AS a, j AS b FROM b JOIN lv ON b.w <= lv.level), t AS (SELECT level, a AS id, a AS label FROM s UNION SELECT s.level, s.b, t.label FROM t JOIN s ON s.a = t.id AND s.level = t.level WHERE t.label < s.b), g AS (SELECT level, id, min(label) AS label FROM t GROUP BY 1, 2) SELECT p.sample_idx AS id, lv.level, coalesce(g.label, p.sample_idx) AS cluster FROM cgmlst_profile p CROSS JOIN lv LEFT JOIN g ON g.id = p.sample_idx AND g.level = lv.level")
def hierarchy_levels(spark, sf_dir):
    """Cluster of every sample at five levels, all from one spanning forest."""
    return cluster.hierarchy(_edges(spark, sf_dir), _nodes(spark, sf_dir), HIER)


@query("WITH RECURSIVE " + BOTH_SQL + ", lv AS (SELECT unnest([0, 3, 7, 12, 20]) AS level), s AS (SELECT level, i AS a, j AS b FROM b JOIN lv ON b.w <= lv.level), t AS (SELECT level, a AS id, a AS label FROM s UNION SELECT s.level, s.b, t.label FROM t JOIN s ON s.a = t.id AND s.level = t.level WHERE t.label < s.b), g AS (SELECT level, id, min(label) AS label FROM t GROUP BY 1, 2) SELECT lv.level, count(DISTINCT coalesce(g.label, p.sample_idx)) AS n_groups FROM cgmlst_profile p CROSS JOIN lv LEFT JOIN g ON g.id = p.sample_idx AND g.level = lv.level GROUP BY 1")
def level_group_counts(spark, sf_dir):
    """Groups at each level."""
    return hierarchy_levels(spark, sf_dir).groupBy("level").agg(F.count_distinct("cluster").alias("n_groups"))


ALL_LEVELS = list(range(65))


def _step(spark, sf_dir):
    """Levels between two evaluated ones: as in the reference 10, or 1 under 1,000 samples."""
    return 10 if _nodes(spark, sf_dir).count() >= 1000 else 1


def _every_level(where: str = "true") -> str:
    """Common tables up to ``h``: id, level, cluster, at every level from 0 to 64 that ``where`` allows."""
    return (
        "WITH RECURSIVE " + BOTH_SQL + f", lv AS (SELECT level FROM (SELECT unnest(range(0, 65))::INT AS level) WHERE {where}), s AS (SELECT level, i AS a, j AS b FROM b JOIN lv ON b.w <= lv.level), "
        "t AS (SELECT level, a AS id, a AS label FROM s UNION SELECT s.level, s.b, t.label FROM t JOIN s ON s.a = t.id AND s.level = t.level WHERE t.label < s.b), g AS (SELECT level, id, min(label) AS label FROM t GROUP BY 1, 2), "
        "h AS (SELECT p.sample_idx AS id, lv.level, coalesce(g.label, p.sample_idx) AS cluster FROM cgmlst_profile p CROSS JOIN lv LEFT JOIN g ON g.id = p.sample_idx AND g.level = lv.level)"
    )


EVALUATED = "level % (CASE WHEN (SELECT count(*) FROM cgmlst_profile) >= 1000 THEN 10 ELSE 1 END) = 0"
#: merges at each weight are the groups below it less the groups at it
MERGES_SQL = _every_level() + ", k AS (SELECT level AS w, count(DISTINCT cluster) AS n_at FROM h GROUP BY 1), m AS (SELECT w, coalesce(lag(n_at) OVER (ORDER BY w), (SELECT count(*) FROM cgmlst_profile)) AS n_before, n_at FROM k)"
CURVE_SQL = MERGES_SQL + ", c AS (SELECT w::DOUBLE AS w, n_before AS n_clusters FROM m WHERE n_before > n_at)"


@query(_every_level() + " SELECT id, level, cluster FROM h")
def hierarchy_all_levels(spark, sf_dir):
    """Cluster of every sample at every level from 0 to the number of loci, all from one spanning forest."""
    return cluster.hierarchy(_edges(spark, sf_dir), _nodes(spark, sf_dir), ALL_LEVELS)


@query(_every_level() + " SELECT level, count(DISTINCT cluster) AS n_groups FROM h GROUP BY 1")
def all_level_group_counts(spark, sf_dir):
    """Groups at every level."""
    return cluster.group_counts(_edges(spark, sf_dir), _nodes(spark, sf_dir), ALL_LEVELS)


#: every pair of samples, which DuckDB compares one by one
ALL_PAIRS_SQL = f"""q AS (SELECT sample_idx, {ALLELES_SQL} AS a FROM cgmlst_profile), z AS (SELECT x.sample_idx AS i, y.sample_idx AS j, greatest(len(list_filter(x.a, lambda v: v > 0)), len(list_filter(y.a, lambda v: v > 0))) - 0.05::DOUBLE * 64 AS ll,
list_zip(x.a, y.a) AS z FROM q x JOIN q y ON x.sample_idx < y.sample_idx), c AS (SELECT i, j, ll, len(list_filter(z, lambda v: v[1] > 0 AND v[2] > 0))::DOUBLE + 1e-12 AS al, len(list_filter(z, lambda v: v[1] > 0 AND v[2] > 0 AND v[1] <> v[2]))::DOUBLE AS ad FROM z),
f AS MATERIALIZED (SELECT * FROM (SELECT i, j, floor((ad + greatest(ll - al, 0)) / (al + greatest(ll - al, 0)) * 64 + 0.5)::INT AS w FROM c) WHERE w <= 7), b AS MATERIALIZED (SELECT i, j, w FROM f UNION ALL SELECT j, i, w FROM f)"""


@query(f"""WITH RECURSIVE {ALL_PAIRS_SQL}, lv AS (SELECT unnest(range(0, 8))::INT AS level), s AS MATERIALIZED (SELECT level, i AS a, j AS b FROM b JOIN lv ON b.w <= lv.level),
t AS (SELECT level, a AS id, a AS label FROM s UNION SELECT s.level, s.b, t.label FROM t JOIN s ON s.a = t.id AND s.level = t.level WHERE t.label < s.b), g AS (SELECT level, id, min(label) AS label FROM t GROUP BY 1, 2)
SELECT p.sample_idx, lv.level, coalesce(g.label, p.sample_idx) AS cluster FROM cgmlst_profile p CROSS JOIN lv LEFT JOIN g ON g.id = p.sample_idx AND g.level = lv.level""")
def profile_hierarchy(spark, sf_dir):
    """Clusters of every sample at the levels 0 to 7, from the profiles alone."""
    return pairs.profile_hierarchy(load_profiles(spark, sf_dir), list(range(8)))


@query()
def spanning_forest(spark, sf_dir):
    """The minimum spanning forest of the listed pairs."""
    return graph.spanning_forest(_edges(spark, sf_dir))


@query(MERGES_SQL + ", x AS (SELECT unnest(list_transform(range(0, n_before - n_at), lambda i: w::DOUBLE)) AS w FROM m WHERE n_before > n_at) SELECT count(*) AS n, min(w) AS least, max(w) AS most, round(avg(w), 6) AS mean, quantile_cont(w, 0.5) AS median FROM x")
def merge_heights(spark, sf_dir):
    """Range, mean and median of the heights at which clusters merge."""
    f = graph.spanning_forest(_edges(spark, sf_dir))
    return f.agg(F.count("*").alias("n"), F.min("w").alias("least"), F.max("w").alias("most"), F.round(F.avg("w"), 6).alias("mean"), F.percentile("w", F.lit(0.5)).alias("median"))


@query(CURVE_SQL + " SELECT w, n_clusters FROM c")
def collapse_curve(spark, sf_dir):
    """Clusters left below each forest weight."""
    return cluster.collapse_curve(graph.spanning_forest(_edges(spark, sf_dir)), _nodes(spark, sf_dir).count())


@query(CURVE_SQL + """, q AS (SELECT floor(0.6::DOUBLE * count(*))::BIGINT AS target FROM cgmlst_profile), y AS (SELECT *, min(n_clusters) OVER (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
SELECT w AS threshold, n_clusters FROM y, q WHERE before IS NULL OR before > target ORDER BY abs(n_clusters - target), w LIMIT 1""")
def collapse_to_target(spark, sf_dir):
    """The threshold that leaves about 60 % of the samples as clusters."""
    n = _nodes(spark, sf_dir).count()
    return cluster.collapse_threshold(cluster.collapse_curve(graph.spanning_forest(_edges(spark, sf_dir)), n), int(0.6 * n))


@query(CURVE_SQL + """, q AS (SELECT floor(0.6::DOUBLE * count(*))::BIGINT AS target FROM cgmlst_profile), y AS (SELECT *, min(n_clusters) OVER (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
x AS (SELECT w AS t FROM y, q WHERE before IS NULL OR before > target ORDER BY abs(n_clusters - target), w LIMIT 1)
SELECT p.sample_idx AS id, coalesce(h.cluster, p.sample_idx) AS rep, x.t AS threshold, count(*) OVER (PARTITION BY coalesce(h.cluster, p.sample_idx)) AS n FROM cgmlst_profile p CROSS JOIN x LEFT JOIN h ON h.id = p.sample_idx AND h.level = x.t - 1""")
def collapse_clusters(spark, sf_dir):
    """The collapsed clusters of about 60 % of the samples: each member with its representative, the threshold and the cluster's size."""
    e, nodes = pin(_edges(spark, sf_dir), "edges"), _nodes(spark, sf_dir)
    return cluster.collapse(e, nodes, int(0.6 * nodes.count()))


@query(f"WITH {EDGE_SQL}, h AS (SELECT DISTINCT w AS h FROM e), k AS (SELECT h, lead(h) OVER (ORDER BY h) - h AS jump FROM h) SELECT h, jump FROM k WHERE jump IS NOT NULL ORDER BY jump DESC, h DESC LIMIT 5")
def top_jumps(spark, sf_dir):
    """Distances before the largest gaps of the sorted distances."""
    return cluster.top_jumps(_edges(spark, sf_dir).select(F.col("w").alias("h")))


DBSCAN_SQL = f"""WITH RECURSIVE {BOTH_SQL}, c AS (SELECT i AS c FROM b WHERE w <= 7 GROUP BY 1 HAVING count(*) + 1 >= 5),
s AS (SELECT i AS a, j AS b FROM b WHERE w <= 7 AND i IN (SELECT c FROM c) AND j IN (SELECT c FROM c)),
t AS (SELECT c AS id, c AS label FROM c UNION SELECT s.b, t.label FROM t JOIN s ON s.a = t.id WHERE t.label < s.b), g AS (SELECT id, min(label) AS root FROM t GROUP BY 1),
k AS (SELECT id, (dense_rank() OVER (ORDER BY root) - 1)::INT AS label FROM g),
o AS (SELECT b.i AS id, min(k.label) AS label FROM b JOIN k ON k.id = b.j WHERE w <= 7 AND b.i NOT IN (SELECT c FROM c) GROUP BY 1)
SELECT p.sample_idx AS id, coalesce(k.label, o.label, -1)::INT AS label, CASE WHEN k.label IS NOT NULL THEN 'core' WHEN o.label IS NOT NULL THEN 'border' ELSE 'noise' END AS role
FROM cgmlst_profile p LEFT JOIN k ON k.id = p.sample_idx LEFT JOIN o ON o.id = p.sample_idx"""


@query(DBSCAN_SQL)
def dbscan_labels(spark, sf_dir):
    """Density clusters at distance 7 with five samples."""
    return cluster.dbscan(_edges(spark, sf_dir), _nodes(spark, sf_dir), 7, 5)


@query("SELECT CASE WHEN label = -1 THEN 'Noise' ELSE label::VARCHAR END AS cluster, count(*) AS n FROM (" + DBSCAN_SQL + ") GROUP BY 1")
def dbscan_sizes(spark, sf_dir):
    """Sizes of the density clusters, noise named."""
    lab = dbscan_labels(spark, sf_dir)
    return lab.groupBy(F.when(F.col("label") == -1, "Noise").otherwise(F.col("label").cast("string")).alias("cluster")).agg(F.count("*").alias("n"))


@query(f"WITH {EDGE_SQL}, q AS (SELECT quantile_cont(w, 0.1)::DOUBLE AS lo, quantile_cont(w, 0.9)::DOUBLE AS hi FROM e) SELECT unnest(range(0, 20))::INT AS k, round(unnest(list_transform(range(0, 20), lambda i: lo + (hi - lo) * i / 19)), 6) AS eps FROM q")
def eps_candidates(spark, sf_dir):
    """Twenty candidate radii between the 10th and 90th percentile."""
    return cluster.eps_candidates(_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {BOTH_SQL}, lim AS (SELECT quantile_cont(w, 0.1)::DOUBLE AS lo, quantile_cont(w, 0.9)::DOUBLE AS hi, quantile_cont(w, 0.5)::DOUBLE AS mid FROM e),
r AS MATERIALIZED (SELECT k, round(lo + (hi - lo) * k / 19, 6) AS eps FROM lim, (SELECT unnest(range(0, 20)) AS k)), near AS MATERIALIZED (SELECT r.k, b.i, b.j FROM b JOIN r ON b.w <= r.eps),
core AS MATERIALIZED (SELECT k, i FROM near GROUP BY 1, 2 HAVING count(*) + 1 >= 5), s AS MATERIALIZED (SELECT n.k, n.i AS a, n.j AS b FROM near n JOIN core x ON x.k = n.k AND x.i = n.i JOIN core y ON y.k = n.k AND y.i = n.j),
t AS (SELECT k, i AS id, i AS label FROM core UNION SELECT s.k, s.b, t.label FROM t JOIN s ON s.a = t.id AND s.k = t.k WHERE t.label < s.b), g AS (SELECT k, id, min(label) AS root FROM t GROUP BY 1, 2),
o AS (SELECT n.k, n.i AS id, min(g.root) AS root FROM near n JOIN g ON g.k = n.k AND g.id = n.j WHERE NOT EXISTS (SELECT 1 FROM core x WHERE x.k = n.k AND x.i = n.i) GROUP BY 1, 2),
h AS MATERIALIZED (SELECT r.k, p.sample_idx AS id, coalesce(g.root, o.root, -1) AS label FROM cgmlst_profile p CROSS JOIN r LEFT JOIN g ON g.k = r.k AND g.id = p.sample_idx LEFT JOIN o ON o.k = r.k AND o.id = p.sample_idx),
kept AS (SELECT k FROM h GROUP BY 1 HAVING count(DISTINCT label) FILTER (WHERE label >= 0) >= 2 AND avg((label = -1)::INT) <= 0.5), z AS (SELECT k, label, count(*) AS m FROM h GROUP BY 1, 2),
d AS (SELECT c.k, b.i, c.label AS lj, avg(w) AS m FROM b JOIN h c ON c.id = b.j JOIN kept USING (k) GROUP BY 1, 2, 3), ab AS (SELECT d.k, d.i, max(CASE WHEN a.label = d.lj THEN d.m END) AS a, min(CASE WHEN a.label <> d.lj THEN d.m END) AS b FROM d JOIN h a ON a.id = d.i AND a.k = d.k GROUP BY 1, 2),
y AS (SELECT h.k, round(CASE WHEN z.m = 1 OR ab.a IS NULL OR ab.b IS NULL OR greatest(ab.a, ab.b) = 0 THEN 0 ELSE (ab.b - ab.a) / greatest(ab.a, ab.b) END, 6)::DOUBLE AS s FROM h JOIN kept USING (k) JOIN z ON z.k = h.k AND z.label = h.label LEFT JOIN ab ON ab.i = h.id AND ab.k = h.k),
v AS (SELECT k, round(avg(s), 6) AS silhouette FROM y GROUP BY 1), w AS (SELECT eps, silhouette FROM v JOIN r USING (k) ORDER BY silhouette DESC, k LIMIT 1) SELECT coalesce((SELECT eps FROM w), mid) AS eps, (SELECT silhouette FROM w) AS silhouette FROM lim""")
def eps_choice(spark, sf_dir):
    """The radius with the best silhouette among twenty candidates, five samples to a core."""
    return cluster.eps_choice(_edges(spark, sf_dir), _nodes(spark, sf_dir))


@query(f"""WITH {BOTH_SQL}, m AS (SELECT i, round(sum(w) / (count(*) + 1.0), 6)::DOUBLE AS m FROM b GROUP BY 1), n AS (SELECT m, row_number() OVER (ORDER BY m, i) - 1 AS k, round(lead(m) OVER (ORDER BY m, i) - m, 6) AS gap FROM m)
SELECT k AS knee_idx, m AS eps FROM n WHERE gap IS NOT NULL ORDER BY gap DESC, k LIMIT 1""")
def eps_knee(spark, sf_dir):
    """The radius at the knee of the sorted mean distances."""
    return cluster.eps_knee(_edges(spark, sf_dir))


@query(f"""WITH p AS (SELECT sample_idx, row_number() OVER (ORDER BY len(list_filter({ALLELES_SQL}, lambda x: x <= 0)), sample_idx) AS r FROM cgmlst_profile),
d AS (SELECT DISTINCT i, j, d1 FROM dist WHERE d1 >= 0 AND i <> j)
SELECT d.i AS id, arg_min(d.j, (d.d1::BIGINT << 40) + b.r) AS parent, min(d.d1) AS d1 FROM d JOIN p a ON a.sample_idx = d.i JOIN p b ON b.sample_idx = d.j WHERE b.r < a.r GROUP BY 1""")
def attach_parents(spark, sf_dir):
    """The earlier sample each sample would attach to."""
    rank = missing_rank(spark, sf_dir).select(F.col("sample_idx").alias("id"), F.col("proc_rank").alias("rank"))
    return cluster.attach_parents(table(spark, sf_dir, "dist"), pin(rank, "rank"))


# evaluation


@query(f"""WITH RECURSIVE {BOTH_SQL}, {_reach('w <= 7')}, z AS (SELECT label, count(*) AS m FROM n GROUP BY 1),
d AS (SELECT b.i, c.label AS lj, avg(w) AS m FROM b JOIN n c ON c.id = b.j GROUP BY 1, 2),
ab AS (SELECT d.i, max(CASE WHEN a.label = d.lj THEN d.m END) AS a, min(CASE WHEN a.label <> d.lj THEN d.m END) AS b FROM d JOIN n a ON a.id = d.i GROUP BY 1)
SELECT n.id, n.label, round(CASE WHEN z.m = 1 OR ab.a IS NULL OR ab.b IS NULL OR greatest(ab.a, ab.b) = 0 THEN 0 ELSE (ab.b - ab.a) / greatest(ab.a, ab.b) END, 6)::DOUBLE AS s
FROM n JOIN z USING (label) LEFT JOIN ab ON ab.i = n.id""")
def silhouette_samples(spark, sf_dir):
    """Silhouette of every sample in the clusters at distance 7."""
    e = pin(_edges(spark, sf_dir), "edges")
    lab = pin(cluster.labels_at(e, _nodes(spark, sf_dir), 7), "labels")
    return evaluate.silhouettes(graph.symmetrised(e), lab)


@query(_every_level(EVALUATED) + """, z AS (SELECT level, cluster, count(*) AS m FROM h GROUP BY 1, 2), d AS (SELECT c.level, b.i, c.cluster AS lj, avg(w) AS m FROM b JOIN h c ON c.id = b.j GROUP BY 1, 2, 3),
ab AS (SELECT d.level, d.i, max(CASE WHEN a.cluster = d.lj THEN d.m END) AS a, min(CASE WHEN a.cluster <> d.lj THEN d.m END) AS b FROM d JOIN h a ON a.id = d.i AND a.level = d.level GROUP BY 1, 2),
y AS (SELECT h.level, round(CASE WHEN z.m = 1 OR ab.a IS NULL OR ab.b IS NULL OR greatest(ab.a, ab.b) = 0 THEN 0 ELSE (ab.b - ab.a) / greatest(ab.a, ab.b) END, 6)::DOUBLE AS s FROM h JOIN z ON z.level = h.level AND z.cluster = h.cluster LEFT JOIN ab ON ab.i = h.id AND ab.level = h.level)
SELECT level, round(avg(s), 6) AS silhouette FROM y GROUP BY 1""")
def silhouette_levels(spark, sf_dir):
    """Mean silhouette at each evaluated level."""
    e = pin(_edges(spark, sf_dir), "edges")
    levels = ALL_LEVELS[:: _step(spark, sf_dir)]
    return evaluate.silhouette_means(graph.symmetrised(e), cluster.named_levels(e, _nodes(spark, sf_dir), levels), levels)


@query("""WITH a AS (SELECT sample_idx, coalesce(country, 'NA') AS u, coalesce(lab_code, 'NA') AS v FROM cgmlst_profile), c AS (SELECT u, v, count(*)::DOUBLE AS c FROM a GROUP BY 1, 2),
m AS (SELECT *, sum(c) OVER (PARTITION BY u) AS cu, sum(c) OVER (PARTITION BY v) AS cv FROM c),
t AS (SELECT sum(c) AS n, sum(c * ln(c / (cu * cv))) AS j, sum(c * ln(cu)) AS hu, sum(c * ln(cv)) AS hv FROM m)
SELECT round(least(greatest((j / n + ln(n)) / ((2 * ln(n) - (hu + hv) / n) / 2), 0), 0.999), 6)::DOUBLE AS nmi FROM t""")
def nmi_country_lab(spark, sf_dir):
    """Mutual information of two labelings of the samples."""
    p = table(spark, sf_dir, "cgmlst_profile")
    lab = lambda c: p.select(F.col("sample_idx").alias("id"), F.coalesce(c, F.lit("NA")).alias("label"))
    return evaluate.mutual_information(lab("country"), lab("lab_code"))


@query(_every_level(EVALUATED) + """, z AS (SELECT level, cluster, count(*)::DOUBLE AS c FROM h GROUP BY 1, 2), e1 AS (SELECT level, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM z GROUP BY 1), e2 AS (SELECT level, CASE WHEN h > 1e-12 THEN h ELSE 0 END AS h FROM e1)
SELECT a.level AS level1, c.level AS level2, round(least(greatest(CASE WHEN a.h + c.h <= 0 THEN 1 ELSE 2 * c.h / (a.h + c.h) END, 0), 0.999), 6)::DOUBLE AS nmi FROM e2 a JOIN e2 c ON a.level < c.level""")
def nmi_levels(spark, sf_dir):
    """Mutual information of every two evaluated levels of the hierarchy."""
    levels = ALL_LEVELS[:: _step(spark, sf_dir)]
    n, sums = cluster.size_sums(graph.valid_rows(table(spark, sf_dir, "dist")), _nodes(spark, sf_dir), levels)
    return evaluate.summed_information(spark, n, sums, levels)


@query("""WITH x AS (SELECT unnest(range(1, 65)) AS k, unnest(""" + ALLELES_SQL + """) AS a, coalesce(lab_code, 'NA') AS label, sample_idx AS id FROM cgmlst_profile), y AS (SELECT id, label, k, (a > 0)::INT::DOUBLE AS x FROM x),
mu AS (SELECT label, k, avg(x) AS m FROM y GROUP BY 1, 2), sp AS (SELECT label, avg(d) AS s FROM (SELECT y.label, id, sqrt(sum((x - m) * (x - m))) AS d FROM y JOIN mu USING (label, k) GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS g FROM mu a JOIN mu b USING (k) WHERE a.label <> b.label GROUP BY 1, 2)
SELECT round(avg(r), 6) AS db FROM (SELECT la, max((p.s + q.s) / g) AS r FROM g JOIN sp p ON p.label = la JOIN sp q ON q.label = lb WHERE g > 0 GROUP BY 1)""")
def davies_bouldin(spark, sf_dir):
    """Davies-Bouldin index of the laboratories over presence of loci."""
    p = load_profiles(spark, sf_dir, ["lab_code"]).select(F.col("sample_idx").alias("id"), F.coalesce("lab_code", F.lit("NA")).alias("label"), F.posexplode("alleles").alias("k", "a"))
    return evaluate.davies_bouldin_of(p.select("id", "label", "k", (F.col("a") > 0).cast("double").alias("x")))


@query(f"""WITH {EDGE_SQL}, n AS (SELECT sample_idx AS id, coalesce(country, 'NA') AS label FROM cgmlst_profile), q AS (SELECT unnest(range(1, 21)) AS p),
a AS (SELECT id, p, row_number() OVER (PARTITION BY p ORDER BY md5(id || '-' || p), id) AS r FROM n CROSS JOIN q), c AS (SELECT label, row_number() OVER (ORDER BY id) AS r FROM n),
l AS (SELECT a.id, a.p, c.label FROM a JOIN c USING (r) UNION ALL SELECT id, 0, label FROM n),
m AS (SELECT x.p, avg(w) AS m FROM e JOIN l x ON x.id = e.u JOIN l y ON y.id = e.v AND x.p = y.p WHERE x.label = y.label GROUP BY 1), r AS (SELECT m AS real FROM m WHERE p = 0)
SELECT round(real, 6) AS real, round(avg(m), 6) AS null_mean, round(stddev_pop(m), 6) AS null_std, round(avg((m <= real)::INT), 6)::DOUBLE AS p_value, round((real - avg(m)) / stddev_pop(m), 4) AS effect FROM m, r WHERE p > 0 GROUP BY real""")
def permutation_pvalue(spark, sf_dir):
    """Are samples of one country closer than under permuted countries?"""
    lab = table(spark, sf_dir, "cgmlst_profile").select(F.col("sample_idx").alias("id"), F.coalesce("country", F.lit("NA")).alias("label"))
    return evaluate.permutation_test(_edges(spark, sf_dir), lab)


# series over the ordered distances

SERIES_SQL = f"WITH {EDGE_SQL}, c AS (SELECT w, count(*) AS c FROM e GROUP BY 1), f AS (SELECT unnest(range(0, 65))::INT AS idx), y AS (SELECT f.idx, round(coalesce(c, 0) / (SELECT max(c) FROM c), 6)::DOUBLE AS x FROM f LEFT JOIN c ON c.w = f.idx)"


def _series(spark, sf_dir):
    h = _edges(spark, sf_dir).groupBy(F.col("w").alias("idx")).agg(F.count("*").alias("c"))
    top = F.broadcast(h.agg(F.max("c").alias("top")))  # one row
    full = spark.range(65).select(F.col("id").cast("int").alias("idx")).join(h, "idx", "left").crossJoin(top)
    return full.select("idx", F.round(F.coalesce("c", F.lit(0)) / F.col("top"), 6).alias("x"))


@query(SERIES_SQL + """, s AS (SELECT *, abs(x - lag(x) OVER (ORDER BY idx)) AS st FROM y), z AS (SELECT *, sum(CASE WHEN st <= 0.002 THEN 0 ELSE 1 END) OVER (ORDER BY idx) AS g FROM s)
SELECT min(idx) AS "start", max(idx) + 1 AS "end" FROM z GROUP BY g HAVING max(idx) + 1 - min(idx) >= 2""")
def plateaus(spark, sf_dir):
    """Flat stretches of the distance histogram."""
    return series.plateaus(_series(spark, sf_dir), 2e-3, 2)


@query(SERIES_SQL + """, r AS (SELECT *, sum(CASE WHEN x = px THEN 0 ELSE 1 END) OVER (ORDER BY idx) AS run FROM (SELECT *, lag(x) OVER (ORDER BY idx) AS px FROM y)),
u AS (SELECT run, floor((min(idx) + max(idx)) / 2)::BIGINT AS idx, min(x) AS x, min(idx) AS lo, max(idx) AS hi FROM r GROUP BY 1), v AS (SELECT *, lag(x) OVER (ORDER BY run) AS l, lead(x) OVER (ORDER BY run) AS n FROM u),
k AS (SELECT v.idx, v.x, coalesce((SELECT max(y.idx) FROM y WHERE y.idx < v.lo AND y.x > v.x), -1) AS bl, coalesce((SELECT min(y.idx) FROM y WHERE y.idx > v.hi AND y.x > v.x), 1000) AS br FROM v WHERE x > l AND x > n AND x >= 0.0005),
o AS (SELECT k.idx, k.x, round(k.x - greatest((SELECT min(y.x) FROM y WHERE y.idx > k.bl AND y.idx <= k.idx), (SELECT min(y.x) FROM y WHERE y.idx >= k.idx AND y.idx < k.br)), 6) AS prominence FROM k)
SELECT idx, x, prominence FROM o WHERE prominence >= 0.0001""")
def peaks(spark, sf_dir):
    """Peaks of the distance histogram."""
    return series.peaks(_series(spark, sf_dir), 0.0005, 0.0001)


@query(SERIES_SQL + " SELECT idx, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 6) AS x FROM y")
def scaled_series(spark, sf_dir):
    return series.scaled(_series(spark, sf_dir))


@query()
def breakpoint_levels(spark, sf_dir):
    """Best peaks of the silhouette over the evaluated levels, by it and by information lost to the next level."""
    step = _step(spark, sf_dir)
    levels = ALL_LEVELS[::step]
    e = pin(_edges(spark, sf_dir), "edges")
    named = cluster.named_levels(e, _nodes(spark, sf_dir), levels)  # once for both
    sil = evaluate.silhouette_means(graph.symmetrised(e), named, levels)
    nmi = pin(evaluate.named_information(named, levels), "nmi")
    idx = lambda c: (F.col(c) / step).cast("int")
    best = series.breakpoint_scores(sil.select(idx("level").alias("idx"), F.col("silhouette").alias("x")), nmi.where(F.col("level2") == F.col("level1") + step).select(idx("level1").alias("idx"), F.col("nmi").alias("x")))
    return best.select((F.col("idx") * step).alias("level"), "idx", "score")


@query(SERIES_SQL + """, s AS (SELECT *, abs(x - lag(x) OVER (ORDER BY idx)) AS st FROM y), z AS (SELECT *, sum(CASE WHEN st <= 0.002 THEN 0 ELSE 1 END) OVER (ORDER BY idx) AS g FROM s),
p AS (SELECT min(idx) AS a FROM z GROUP BY g HAVING max(idx) + 1 - min(idx) >= 2), q AS (SELECT array_agg(DISTINCT a ORDER BY a) AS c FROM p) SELECT coalesce(c[1], 0) AS "first", coalesce(c[2], c[1]) AS "second" FROM q""")
def threshold_pick(spark, sf_dir):
    """First two candidate thresholds: starts of the flat stretches."""
    return series.first_two(plateaus(spark, sf_dir).select(F.col("start").alias("idx")))


# one-row choices and small reports


@query(_every_level() + ", k AS (SELECT level, count(DISTINCT cluster) AS n_groups FROM h GROUP BY 1) SELECT min(level) AS level FROM k WHERE n_groups < 1000")
def first_small_level(spark, sf_dir):
    """The first level with fewer than 1,000 groups; null if none has."""
    return all_level_group_counts(spark, sf_dir).where("n_groups < 1000").agg(F.min("level").alias("level"))


@query(f"WITH RECURSIVE {BOTH_SQL}, {_reach('w <= 7')} SELECT label, count(*) AS size FROM n GROUP BY 1 ORDER BY size DESC, label LIMIT 6")
def top_components(spark, sf_dir):
    """The six largest clusters at distance 7."""
    return cluster.labels_at(_edges(spark, sf_dir), _nodes(spark, sf_dir), 7).groupBy("label").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "label").limit(6)


@query(f"WITH {EDGE_SQL}, q AS (SELECT quantile_cont(w, 0.95)::DOUBLE AS top FROM e) SELECT u, v, round(least(w, top), 6)::DOUBLE AS shown FROM e, q")
def winsorised_edges(spark, sf_dir):
    """Edge lengths held to their 95th percentile, as a drawing uses them."""
    e = _edges(spark, sf_dir)
    top = F.broadcast(e.agg(F.percentile("w", F.lit(0.95)).alias("top")))  # one row
    return e.crossJoin(top).select("u", "v", F.round(F.least(F.col("w").cast("double"), "top"), 6).alias("shown"))


@query(SQL["nmi_levels"].replace("SELECT a.level AS level1", "SELECT level1, level2, round(10 * log10(1 - nmi), 4) AS heat FROM (SELECT a.level AS level1") + ")")
def nmi_heat(spark, sf_dir):
    """The colour value of every two evaluated levels."""
    return nmi_levels(spark, sf_dir).select("level1", "level2", F.round(10 * F.log10(1 - F.col("nmi")), 4).alias("heat"))


@query(CURVE_SQL + ", jumps AS (SELECT w AS h, lead(w) OVER (ORDER BY w) - w AS jump FROM c) SELECT h, jump FROM jumps WHERE jump IS NOT NULL ORDER BY jump DESC, h DESC LIMIT 5")
def merge_jumps(spark, sf_dir):
    """Merge heights before the five largest gaps between heights."""
    return cluster.top_jumps(graph.spanning_forest(_edges(spark, sf_dir)).select(F.col("w").alias("h")))


@query(MERGES_SQL + ", q AS (SELECT floor(0.4::DOUBLE * count(*))::BIGINT AS k FROM cgmlst_profile), y AS (SELECT w, n_at FROM m, q WHERE n_at <= k) SELECT min(w) AS level, arg_min(n_at, w) AS n_groups FROM y")
def cut_at_count(spark, sf_dir):
    """The lowest level that leaves at most 40 % of the samples as groups, and how many; nulls if none does."""
    k = int(0.4 * _nodes(spark, sf_dir).count())
    return all_level_group_counts(spark, sf_dir).where(F.col("n_groups") <= k).agg(F.min("level").alias("level"), F.min_by("n_groups", "level").alias("n_groups"))


@query("SELECT count(DISTINCT label) FILTER (WHERE label <> -1) AS n_clusters, count(*) FILTER (WHERE label = -1) AS n_noise, count(*) FILTER (WHERE role = 'core') AS n_core, count(*) FILTER (WHERE role = 'border') AS n_border FROM (" + DBSCAN_SQL + ")")
def dbscan_summary(spark, sf_dir):
    """Clusters without noise, and samples by their role."""
    role = lambda r: F.count_if(F.col("role") == r).alias(f"n_{r}")
    return dbscan_labels(spark, sf_dir).agg(F.count_distinct(F.when(F.col("label") != -1, F.col("label"))).alias("n_clusters"), role("noise"), role("core"), role("border"))


@query(f"""SELECT count(*) AS n_profiles, sum(n)::BIGINT AS n_samples, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS n_in_copies, max(n) AS most_copies FROM (SELECT count(*) AS n FROM (SELECT {ALLELES_SQL} AS a FROM cgmlst_profile) GROUP BY a)""")
def run_summary(spark, sf_dir):
    """Profiles, samples, samples that share a profile, and the most copies of one."""
    n = load_profiles(spark, sf_dir).groupBy("alleles").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_profiles"), F.sum("n").alias("n_samples"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_in_copies"), F.max("n").alias("most_copies"))


# layouts


def _levels(spark, sf_dir):
    return pin(graph.rooted_levels(graph.spanning_forest(_edges(spark, sf_dir)), _nodes(spark, sf_dir)), "rooted")


@query()
def tree_layout(spark, sf_dir):
    """Tree drawing of the whole forest, samples without pairs as trees of their own."""
    return graph.tree_layout(_levels(spark, sf_dir))


@query()
def radial_layout(spark, sf_dir):
    return graph.radial_layout(_levels(spark, sf_dir))


@query()
def hierarchical_layout(spark, sf_dir):
    return graph.hierarchical_layout(_levels(spark, sf_dir))


@query(f"""WITH {BOTH_SQL}, d AS (SELECT i AS id, count(*) AS degree FROM b WHERE w <= 7 GROUP BY 1), m AS (SELECT max(degree) AS top FROM d)
SELECT id, greatest(100, 50 * degree) AS size, CASE WHEN degree >= 0.7 * top THEN 'hub' WHEN degree >= 0.4 * top THEN 'middle' ELSE 'leaf' END AS class FROM d, m""")
def node_attributes(spark, sf_dir):
    """Size and class of the nodes of a drawing."""
    d = graph.degrees(_edges(spark, sf_dir).where("w <= 7"))
    top = F.broadcast(d.agg(F.max("degree").alias("top")))  # one row
    return d.crossJoin(top).select("id", F.greatest(F.lit(100), 50 * F.col("degree")).alias("size"), F.when(F.col("degree") >= 0.7 * F.col("top"), "hub").when(F.col("degree") >= 0.4 * F.col("top"), "middle").otherwise("leaf").alias("class"))


@query("""SELECT run_id, count(*) AS n_clusters, sum(len(list_filter(list_distinct(cluster_to_samples), lambda x: x IS NOT NULL)))::BIGINT AS n_samples,
count(*) FILTER (WHERE sample_counts IS DISTINCT FROM len(list_filter(list_distinct(cluster_to_samples), lambda x: x IS NOT NULL))) AS n_wrong FROM (SELECT DISTINCT * FROM collapse_metadata) GROUP BY 1""")
def collapse_report(spark, sf_dir):
    """Clusters, samples and wrong counts of each collapse run."""
    m = table(spark, sf_dir, "collapse_metadata").distinct().withColumn("n", F.size(F.array_distinct(F.filter("cluster_to_samples", lambda x: x.isNotNull()))))
    return m.groupBy("run_id").agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_samples"), F.count_if(~F.col("sample_counts").eqNullSafe(F.col("n"))).alias("n_wrong"))


@query("""SELECT DISTINCT cluster_id, rep_idx, list_sort(list_filter(list_distinct(cluster_to_samples), lambda x: x IS NOT NULL)) AS members FROM collapse_metadata""")
def collapse_members(spark, sf_dir):
    """Members of every collapsed cluster, sorted, once."""
    return table(spark, sf_dir, "collapse_metadata").select("cluster_id", "rep_idx", F.array_sort(F.array_distinct(F.filter("cluster_to_samples", lambda x: x.isNotNull()))).alias("members")).distinct()


@query("""SELECT user_id, event_type, floor(hour(ts) / 4)::INT AS slot, (count(*) % 5)::INT AS allele FROM events GROUP BY 1, 2, 3""")
def event_profile(spark, sf_dir):
    """Long-form profiles counted from an event table."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.floor(F.hour("ts") / 4).cast("int").alias("slot")).agg((F.count("*") % 5).cast("int").alias("allele"))


@query("""SELECT vec_id, list_transform(embedding, lambda x: least(greatest(floor((x::DOUBLE + 0.3) * 10), 0), 6)::INT) AS alleles, label FROM embeddings""")
def embedding_profile(spark, sf_dir):
    """Vectors quantised to allele codes."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x.cast("double") + 0.3) * 10), F.lit(0)), F.lit(6)).cast("int")).alias("alleles"), "label")
