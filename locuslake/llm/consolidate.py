"""Best representative of each duplicate group: iterative truth discovery.

Every claim is (group, field, member, value, source). Rounds alternate: a
value's support is the sum of the reliabilities of the claims for it, the value
with most support is the field's truth, and a source's reliability is the
smoothed share of its claims that agree with the truth. Rounds end when no
reliability changes any more, so that no truth does.

A declared order of trust (rank, then recency, then the smaller member) enters
as a prior: the value of the field's first claim in that order gets the share
``prior`` of the field's votes, the votes themselves count for the rest. At 0
the votes decide alone; at one half the first claim cannot be outvoted, which is
the limit in which the declared order holds; between the two it is a head start
that reliable sources can overrule.

Claims are added up once to a row per (group, field, value) with its votes by
source; fields with one value are settled there, and the rounds run over the
others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin, unpin

#: Spellings of "not known", compared by letters and digits in lower case.
STAND_INS = [
    "na", "nan", "nil", "none", "null", "unknown", "unk", "missing", "tbd", "tba", "tbc", "notknown", "notprovided",
    "notavailable", "notapplicable", "notcollected", "notgiven", "notspecified", "notreported", "notdetermined", "nodata",
    "undefined", "undetermined", "unspecified", "unavailable", "empty", "blank", "noname", "nd", "xxx",
]


def known_text(c: Column) -> Column:
    """Whether a text says something: not null or blank, has a letter, is no stand-in for "not known"."""
    bare = F.lower(F.regexp_replace(c, r"[^\p{L}\p{Nd}]", ""))
    return F.coalesce(c.rlike(r"\p{L}") & ~bare.isin(STAND_INS), F.lit(False))


def claims_from_members(members: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Long claims ``group_id, member, source, ts, field_name, value`` from member rows; null values claim nothing."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), c.cast("string").alias("value")) for n, c in fields.items()])).alias("c")
    return members.select("group_id", "member", "source", "ts", each).select("group_id", "member", "source", "ts", "c.field_name", "c.value").where("value is not null")


def discover_truth(
    claims: DataFrame, trust: DataFrame | None = None, vote: str = "sum", prior: float | None = None, smooth: float = 2.0, max_rounds: int = 200, max_sources: int = 100_000
) -> tuple[DataFrame, DataFrame]:
    """``(truth, sources)``: per group and field the chosen value, its member and support; per source its reliability.

    ``claims``: group_id, member, source, ts, field_name, value. ``trust``:
    source, rank (1 = most trusted; equal ranks share one reliability); sources
    without a rank, and null sources, form the last class. ``prior`` is 0 for vote
    ``sum`` and one half for vote ``best`` unless given. Null timestamps come
    last. A group none of whose members has a field gives no row for it. Repeated
    claims count once. Sums combine map-side, so neither a huge group nor a huge
    source is collected; the reliabilities of at most ``max_sources`` sources pass
    through the driver, more are refused. If rounds come back to an earlier state
    instead of settling, the state of the cycle with the least reliabilities is
    taken; if ``max_rounds`` do not end, an error is raised.
    """
    prior = (0.5 if vote == "best" else 0.0) if prior is None else prior
    claims, first = _in_order(claims, trust)
    # a member's claims on a field: one row each, whatever the repeats
    votes = claims.groupBy("group_id", "field_name", "value", "cls", "member").agg(F.min(first).alias("best"))
    votes = votes.groupBy("group_id", "field_name", "value", "cls").agg(F.count("*").alias("n"), F.min("best").alias("best"))
    # at most one entry a source
    values = votes.groupBy("group_id", "field_name", "value").agg(F.array_sort(F.collect_list(F.struct("cls", "n"))).alias("votes"), F.min("best").alias("best"))
    values = pin(values, "values")
    held = F.struct("value", "votes", "best")
    fields = pin(values.groupBy("group_id", "field_name").agg(F.count("*").alias("c"), F.min_by(held, "best").alias("w")), "fields")
    settled = fields.where("c = 1").select("group_id", "field_name", "w.*")
    if prior >= 0.5:  # no vote can overturn the first claim: its value is the truth, and the sources are counted once
        truth = fields.select("group_id", "field_name", "w.*")
        said, agreed = _per_source(values, max_sources), _per_source(truth, max_sources)
        unpin(values)
        return _with_support(truth, {s: (agreed.get(s, 0) + smooth * 0.8) / (n + smooth) for s, n in said.items()})
    open_ = pin(values.join(fields.where("c > 1").select("group_id", "field_name"), ["group_id", "field_name"]), "open")
    said = _per_source(values, max_sources)
    agreed = _per_source(settled, max_sources)
    rel = dict.fromkeys(said, 0.8)
    states = [rel]
    for _ in range(max_rounds):
        now = _per_source(_winners(open_, rel, prior), max_sources)
        new = {s: (agreed.get(s, 0) + now.get(s, 0) + smooth * 0.8) / (n + smooth) for s, n in said.items()}
        if new in states:
            cycle = states[states.index(new) :]
            rel = min(cycle, key=lambda x: sorted(x.items()))
            break
        states.append(new)
        rel = new
    else:
        raise RuntimeError(f"truth not stable after {max_rounds} rounds")
    unpin(values)
    truth = _winners(open_, rel, prior).unionByName(settled)
    return _with_support(truth, rel)


def first_claims(claims: DataFrame, trust: DataFrame | None = None) -> DataFrame:
    """``group_id, field_name, value, member``: the first claim of each field in the declared order, without votes or reliabilities.

    The truth of ``discover_truth`` with a prior of one half or more, where no vote counts.
    """
    claims, first = _in_order(claims, trust)
    best = claims.groupBy("group_id", "field_name").agg(F.min(F.struct(first.alias("at"), "value", "member")).alias("b"))
    return best.select("group_id", "field_name", "b.value", "b.member")


def _in_order(claims: DataFrame, trust: DataFrame | None) -> tuple[DataFrame, Column]:
    """``(claims, first)``: claims that say something with the ``cls`` of their source, and the column that puts them in the declared order."""
    last = 2**31 - 1
    claims = claims.select("group_id", "field_name", "member", "value", "source", "ts").where("group_id is not null and member is not null and value is not null")
    if trust is not None:
        ranks = trust.where("source is not null").groupBy("source").agg(F.min("rank").cast("int").alias("rank")).withColumnRenamed("source", "_s")
        claims = claims.join(ranks, F.col("source") == F.col("_s"), "left").withColumn("rank", F.coalesce("rank", F.lit(last))).withColumn("cls", F.col("rank").cast("string"))
    else:
        claims = claims.withColumn("rank", F.lit(0)).withColumn("cls", F.coalesce("source", F.lit("?")))
    first = F.struct("rank", F.col("ts").isNull().alias("n"), (-F.unix_micros(F.coalesce(F.col("ts").cast("timestamp"), F.timestamp_seconds(F.lit(0))))).alias("t"), F.col("member").alias("member"))
    return claims, first


def _with_support(truth: DataFrame, rel: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """``(truth, sources)`` as ``discover_truth`` gives them."""
    held = truth.crossJoin(F.broadcast(_row(truth, rel))).select("group_id", "field_name", "value", F.col("best.member").alias("member"), _support().alias("support"))
    return held, truth.sparkSession.createDataFrame(sorted(rel.items()), "source string, reliability double")


def _per_source(values: DataFrame, most: int) -> dict[str, int]:
    """Votes of each source in all."""
    rows = values.select(F.explode("votes").alias("v")).groupBy("v.cls").agg(F.sum("v.n").alias("n")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} sources")
    return dict(rows)


def _row(df: DataFrame, rel: dict[str, float]) -> DataFrame:
    """One row with the reliabilities as a map."""
    return df.sparkSession.createDataFrame([(rel,)], "rel map<string,double>")


def _support() -> Column:
    return F.round(F.aggregate("votes", F.lit(0.0), lambda s, v: s + v.n * F.coalesce(F.try_element_at("rel", v.cls), F.lit(0.0))), 9)


def _winners(values: DataFrame, rel: dict[str, float], prior: float) -> DataFrame:
    """``group_id, field_name, value, votes, best``: the value of each field with most support, the prior added."""
    scored = values.crossJoin(F.broadcast(_row(values, rel))).withColumn("s", _support())  # one row
    held = F.struct("value", "votes", "best", "s")
    best = scored.groupBy("group_id", "field_name").agg(F.min_by(held, "best").alias("a"), F.min_by(held, F.struct((-F.col("s")).alias("s"), "best")).alias("b"), F.sum("s").alias("all"))
    head_start = F.lit(prior) * F.col("all") + F.lit(1 - prior) * (F.col("a.s") - F.col("b.s"))
    w = F.when((F.lit(prior) >= 0.5) | (head_start > 0) | (F.col("a.value") == F.col("b.value")), F.col("a")).otherwise(F.col("b"))
    return best.select("group_id", "field_name", w.alias("w")).select("group_id", "field_name", "w.value", "w.votes", "w.best")
