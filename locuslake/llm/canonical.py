"""Duplicates hidden by formatting differences: dictionary-encoded records.

Raw rows that agree byte for byte collapse first. Every distinct raw token is
canonicalised once and gets an integer identifier from its column's
dictionary; a record becomes the sorted tuple of (locus, identifier) integers;
equal tuples under the same identifier of ``st`` are one record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.hotkeys import number_within_key
from ..operators.packed import split_packed
from ..session import pin, unpin

LABEL = r"^[Ll]([0-9]{1,18})[:=](.*)$"


def dictionary(values: DataFrame, raw: str, canonical) -> DataFrame:
    """``raw, id`` for each distinct raw value; spellings of one canonical value share the id, numbered from 1.

    ``canonical`` maps a column to its canonical form; null or empty forms get no row.
    """
    raws = values.select(F.col(raw)).distinct().withColumn("canon", canonical(F.col(raw))).where("canon <> ''")
    ids = number_within_key(raws.select("canon").distinct().withColumn("one", F.lit(0)), "one", ["canon"]).select("canon", (F.col("_n") + 1).alias("id"))
    return raws.join(ids, "canon").select(raw, "id")


def letters_and_digits(c):
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{Nd}]", ""))


def encode_records(df: DataFrame, row_id: str, number: str, packed: str) -> DataFrame:
    """``row_id, first_id, tuple``: each row, the smallest row of its record, the record's integer tuple.

    A row with a null ``number`` or a null, empty or blank ``packed`` field
    matches nothing: its ``first_id`` is itself and its tuple null. Other
    columns are ignored, an empty table gives no rows, a repeated row id is a
    repeated row.
    """
    slim = df.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{number}`").alias("st"), F.col(f"`{packed}`").alias("field"))
    slim = slim.withColumn("ok", F.col("st").isNotNull() & F.col("field").isNotNull() & (F.regexp_replace("field", r"[\p{IsWhite_Space}]", "") != ""))
    # equal spellings once, by two hashes of the text; the smallest row stands for them
    spelling = [F.xxhash64("st", "field").alias("h1"), F.xxhash64(F.lit(7), "field", "st").alias("h2")]
    rows = pin(slim.select("id", "ok", *spelling), "rows")
    raw = pin(slim.where("ok").select("id", "st", "field", *spelling).groupBy("h1", "h2").agg(F.min("id").alias("first"), F.first("st").alias("st"), F.first("field").alias("field")), "spellings")
    places = split_packed(raw, "field", ["first"])
    label = F.regexp_extract("token", LABEL, 1)
    tokens = pin(
        places.select(
            "first",
            F.when(label != "", label.cast("long")).otherwise(F.col("pos").cast("long")).alias("locus"),
            F.when(label != "", F.regexp_extract("token", LABEL, 2)).otherwise(F.col("token")).alias("value"),
        ).where("value <> ''"),
        "tokens",
    )
    values = pin(dictionary(tokens, "value", letters_and_digits), "values")
    numbers = dictionary(raw.withColumnRenamed("st", "number"), "number", lambda c: F.concat(F.lit("#"), F.regexp_replace(c, r"[^0-9]", "")))
    # hot tokens make this join uneven; the adaptive skew join splits them, the dictionary side has one row each
    coded = tokens.join(values, "value").groupBy("first").agg(F.array_sort(F.collect_set(F.struct("locus", "id"))).alias("pairs"))
    records = raw.join(numbers, F.col("st") == F.col("number")).select("first", "h1", "h2", F.col("id").alias("st_id"))
    none = F.array().cast("array<struct<locus:bigint,id:bigint>>")
    records = pin(records.join(coded, "first", "left").select("first", "h1", "h2", F.struct("st_id", F.coalesce("pairs", none).alias("pairs")).alias("tuple")), "records")
    unpin(tokens)
    unpin(values)
    keep = records.groupBy("tuple").agg(F.min("first").alias("keep"))
    spelled = records.join(keep, "tuple").select("h1", "h2", "keep", "tuple")
    matched = rows.where("ok").join(spelled, ["h1", "h2"]).select("id", F.col("keep").alias("first_id"), "tuple")
    alone = rows.where("not ok").select("id", F.col("id").alias("first_id"), F.lit(None).cast(spelled.schema["tuple"].dataType).alias("tuple"))
    return matched.unionByName(alone).withColumnRenamed("id", row_id)
