"""Reading profile tables: delimiter sniffing, format detection, normalisation."""

from __future__ import annotations

import lzma
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tokens
from ..operators.hotkeys import number_within_key


def first_lines(spark: SparkSession, path: str, n: int = 10) -> list[str]:
    """The first ``n`` lines; ``.gz`` is read by Spark, ``.xz`` through the standard library."""
    if path.endswith(".xz"):
        blob = spark.read.format("binaryFile").load(path).select("content").first()
        return lzma.decompress(bytes(blob[0])).decode("utf-8").splitlines()[:n] if blob else []
    return [r[0] for r in spark.read.text(path).limit(n).collect()]


def sniff(lines: list[str]) -> str:
    """Delimiter of a table by its first line: tab, comma, or white space."""
    if not lines or not any(line.strip() for line in lines):
        raise ValueError("empty file")
    head = lines[0]
    if "\t" in head:
        return "\t"
    return "," if "," in head else " "


def read_table(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A delimited table with a header, all columns strings."""
    sep = sep or sniff(first_lines(spark, path, 2))
    if path.endswith(".xz"):
        rows = spark.sparkContext.binaryFiles(path).flatMap(lambda kv: lzma.decompress(kv[1]).decode("utf-8").splitlines())
        return spark.read.option("sep", sep).option("header", True).option("inferSchema", False).csv(rows)
    return spark.read.option("sep", sep).option("header", True).option("inferSchema", False).csv(path)


def detect(columns: list[str], first_line: str) -> str:
    """enterobase, regular, tokens or matrix, by the column names; later tests win."""
    kind = ""
    if "Name" in columns:
        kind = "regular"
    if "checksum" in columns and ("cgmlst" in columns or "cgMLST" in columns):
        kind = "tokens"
    if "ST" in columns and "Name" not in columns:
        kind = "enterobase"
    if kind:
        return kind
    if len(re.split(r"\s+", first_line.strip())) > 1 and re.fullmatch(r"[\s\d-]+", first_line):
        return "matrix"
    raise ValueError("not a profile table: no ST, no checksum with cgmlst, no numeric matrix")


def _from_strings(df: DataFrame, id_col: str, locus_cols: list[str]) -> DataFrame:
    """Rows with positive identifiers and their alleles; if any cell is no plain number, one dictionary codes the others."""
    cells = F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in locus_cols])
    rows = df.select(F.col(f"`{id_col}`").alias("name"), cells.alias("cells"), F.monotonically_increasing_id().alias("line"))
    odd = rows.where(F.exists("cells", lambda x: tokens.numeric_allele(x).isNull()) | ~F.coalesce(F.col("name").rlike(r"^\s*-?[0-9]{1,18}\s*$"), F.lit(False))).limit(1).count()
    if not odd:
        ids = F.trim("name").cast("bigint")
        return rows.select(ids.alias("st_id"), F.col("name"), F.transform("cells", lambda x: tokens.numeric_allele(x).cast("int")).alias("alleles"), "line").where("st_id > 0")
    numbered = number_within_key(rows.withColumn("one", F.lit(0)), "one", ["line"])
    used = numbered.select(F.explode("cells").alias("c")).select(F.trim("c").alias("token")).distinct().withColumn("v", tokens.numeric_allele(F.col("token")))
    top = used.agg(F.coalesce(F.max("v"), F.lit(0)).alias("top"))
    coded = number_within_key(used.where("v is null").withColumn("one", F.lit(0)), "one", ["token"]).crossJoin(F.broadcast(top)).select("token", (F.col("top") + F.col("_n") + 1).alias("code"))
    long = numbered.select("line", F.posexplode("cells").alias("k", "c")).select("line", "k", F.trim("c").alias("token"))
    long = long.join(coded, "token", "left").select("line", "k", F.coalesce(tokens.numeric_allele(F.col("token")), "code").alias("a"))
    arrays = long.groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "a"))), lambda x: x.a.cast("int")).alias("alleles"))
    return numbered.select("name", "line", (F.col("_n") + 1).alias("st_id")).join(arrays, "line").select("st_id", "name", "alleles", "line")


def read_profiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """``(profiles, counts, loci)``: canonical profiles with the first row of every identifier, rows per identifier, locus names.

    ``profiles``: st_id, name, alleles (0 = missing). Formats: a header with
    ``ST`` (and ``Name``), ``checksum`` with a token string, or a bare numeric
    matrix. Header columns that begin with '#' are left out, but the first.
    """
    lines = first_lines(spark, path)
    sep = sniff(lines)
    header = re.split(r"\s+", lines[0].strip()) if sep == " " else [c.strip().strip('"') for c in lines[0].split(sep)]
    if header and header[0].startswith("#"):
        kind = "enterobase"
    else:
        kind = detect(header, lines[0])
    if kind == "matrix":
        text = spark.read.text(path).where(F.trim("value") != "").withColumn("line", F.monotonically_increasing_id()).withColumn("one", F.lit(0))
        rows = number_within_key(text, "one", ["line"])
        p = rows.select((F.col("_n") + 1).alias("st_id"), (F.col("_n") + 1).cast("string").alias("name"), F.transform(F.split(F.trim("value"), r"\s+"), lambda x: F.coalesce(tokens.numeric_allele(x), F.lit(0)).cast("int")).alias("alleles"), "line")
        loci = [f"L{k}" for k in range(1, len(header) + 1)]
    elif kind == "tokens":
        df = read_table(spark, path, sep)
        field = "cgmlst" if "cgmlst" in df.columns else "cgMLST"
        df = df.select("checksum", F.col(field).alias("field"), F.monotonically_increasing_id().alias("line"))
        counts = df.groupBy("checksum").agg(F.count("*").alias("n"), F.min("line").alias("line"))
        kept = number_within_key(df.join(counts.select("line"), "line").withColumn("one", F.lit(0)), "one", ["line"])
        split = kept.select((F.col("_n") + 1).alias("st_id"), F.col("checksum").alias("name"), tokens.split_tokens(F.col("field")).alias("t"), "line")
        width = split.agg(F.max(F.size("t"))).first()[0] or 0
        p = split.select("st_id", "name", F.transform(tokens.pad(F.col("t"), F.lit(width)), lambda x: F.coalesce(tokens.token_to_int(x), F.lit(0)).cast("int")).alias("alleles"))
        return p, counts.select(F.col("checksum").alias("id"), "n"), [f"L{k}" for k in range(1, width + 1)]
    else:
        df = read_table(spark, path, None if sep == " " else sep)
        id_col = "ST" if "ST" in df.columns else df.columns[0]
        loci = [c for c in df.columns if c not in (id_col, "Name") and not c.startswith("#")]
        p = _from_strings(df, id_col, loci)
    counts = p.groupBy(F.col("st_id").cast("string").alias("id")).agg(F.count("*").alias("n"))
    first = Window.partitionBy("st_id").orderBy("line")
    p = p.withColumn("r", F.row_number().over(first)).where("r = 1").select("st_id", "name", "alleles")
    return p, counts, loci


EVALUATION = T.StructType().add("section", T.StringType()).add("label", T.StringType()).add("other", T.StringType()).add("x", T.DoubleType())


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """``section, label, other, x`` of an evaluation report: silhouettes, then the matrix of mutual information."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    sil = lines.where(F.col("value").startswith("#Silhouette")).select(F.split("value", "\t").alias("f"))
    sil = sil.select(F.lit("silhouette").alias("section"), F.col("f")[1].alias("label"), F.lit(None).cast("string").alias("other"), F.expr("try_cast(f[2] as double)").alias("x"))
    head = lines.where(F.col("value").startswith("#NMI")).select(F.slice(F.split("value", "\t"), 2, 1_000_000).alias("names"))
    body = lines.where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f"))
    nmi = body.crossJoin(F.broadcast(head)).select(F.col("f")[0].alias("label"), F.posexplode(F.slice("f", 2, 1_000_000)).alias("k", "v"), "names")
    nmi = nmi.select(F.lit("nmi").alias("section"), "label", F.get("names", F.col("k")).alias("other"), F.expr("try_cast(v as double)").alias("x"))
    return sil.unionByName(nmi)


def read_level(spark: SparkSession, path: str, level: int) -> DataFrame:
    """One level of a stored hierarchy; only its partition is read."""
    return spark.read.parquet(path).where(F.col("level") == level).select("id", "cluster")
