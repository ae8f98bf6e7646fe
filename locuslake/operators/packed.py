"""Several values packed in one field: a parsing expression grammar over Arrow batches.

    field   <- ws? place (sep place)* ws?
    place   <- (quoted / bracketed / bare)*
    quoted  <- '"' ('""' / !'"' .)* '"'  /  "'" ("''" / !"'" .)* "'"
    bracketed <- '[' (!']' .)* ']'  (pairs are a parameter)
    bare    <- a letter, a digit or one of the extra token characters
    sep     <- ws? (any other character) ws?  /  ws

Alternatives are ordered, and a repeat gives nothing back: a doubled quote is
never split. A quote or bracket that never closes fails its alternative; the
parser backtracks to the character itself, which then separates, and flags the
place that holds the rest of it with ``malformed``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_CHARS = "~.:=-"


def grammar(token_chars: str = TOKEN_CHARS, brackets: str = "") -> re.Pattern:
    """The lexeme alternatives in order; ``brackets`` lists opening and closing characters in turn."""
    extra = re.escape(token_chars)
    alts = [r'"(?P<dq>(?:[^"]|"")*+)"', r"'(?P<sq>(?:[^']|'')*+)'"]
    pairs = [brackets[i : i + 2] for i in range(0, len(brackets), 2)]
    if pairs:
        alts.append("(?P<br>" + "|".join(f"{re.escape(a)}[^{re.escape(b)}]*{re.escape(b)}" for a, b in pairs) + ")")
    opening = "".join(re.escape(p[0]) for p in pairs)
    alts += [rf"(?P<bare>(?:[^\W_]|[{extra}])+)", rf"(?P<lone>[\"'{opening}])", rf"\s*(?P<sep>[^\w\s{extra}\"'{opening}]|_)", r"(?P<ws>\s+)"]
    return re.compile("|".join(alts), re.S)


_LONE = re.compile("(?P<lone>.)", re.S)


def parse_field(text: str | None, pattern: re.Pattern, brackets: str = "") -> list[tuple[int, str, str, bool]]:
    """``(pos, token, kind, malformed)`` for each place, empty ones too; null gives none."""
    if text is None:
        return []
    text = text.strip()
    if not text:
        return []
    out, pos, at, n = [], 1, 0, len(text)
    parts: list[str] = []
    kind, bad = "", False
    last = {brackets[i]: text.rfind(brackets[i + 1]) for i in range(0, len(brackets), 2)}  # no closer beyond: not looked for

    def lexeme(at: int) -> re.Match | None:
        return pattern.match(text, at) if last.get(text[at], n) > at else _LONE.match(text, at)

    while at < n:
        m = lexeme(at)
        name = m.lastgroup if m else "sep"
        at = m.end() if m else at + 1
        if name == "bare":
            parts.append(m["bare"])
        elif name == "dq":
            parts.append(m["dq"].replace('""', '"'))
        elif name == "sq":
            parts.append(m["sq"].replace("''", "'"))
        elif name == "br":
            parts.append(m["br"][1:-1])
        else:
            next_bad = name == "lone"
            out.append((pos, "".join(parts), kind or "empty", bad))
            pos, parts, kind, bad = pos + 1, [], "", next_bad
            # white space beside another separator means nothing
            while at < n and text[at].isspace():
                at += 1
            if name == "ws" and at < n:
                m = lexeme(at)
                if m and m.lastgroup in ("sep", "lone"):
                    bad = m.lastgroup == "lone"
                    at = m.end()
                    while at < n and text[at].isspace():
                        at += 1
            continue
        now = {"bare": "bare", "dq": "quoted", "sq": "quoted", "br": "bracketed"}[name]
        kind = now if kind in ("", now) else "mixed"
    out.append((pos, "".join(parts), kind or "empty", bad))
    return out


PLACE = T.StructType().add("pos", T.IntegerType()).add("token", T.StringType()).add("kind", T.StringType()).add("malformed", T.BooleanType())


def split_packed(df: DataFrame, field: str, keep: list[str], token_chars: str = TOKEN_CHARS, brackets: str = "") -> DataFrame:
    """One row per place of ``field``: the ``keep`` columns, ``pos``, ``token``, ``kind``, ``malformed``.

    ``kind`` is bare, quoted, bracketed, mixed or empty. A null, empty or blank
    field gives no row. Only ``keep`` and ``field`` are read, so extra columns
    cost nothing; a kept column named like an output column is refused. A field
    of any length is parsed whole; the work is one pass without a shuffle.
    """
    clash = {"pos", "token", "kind", "malformed"} & set(keep)
    if clash:
        raise ValueError(f"kept columns clash with the result's: {sorted(clash)}")
    slim = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{field}`").alias("_field"))
    schema = T.StructType([*slim.schema.fields[: len(keep)], *PLACE.fields])
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = grammar(token_chars, brackets)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                places = [parse_field(t, pattern, brackets) for t in part.column(len(names)).to_pylist()]
                take = pa.array([i for i, ps in enumerate(places) for _ in ps], pa.int64())
                flat = [p for ps in places for p in ps]
                cols = [part.column(i).take(take) for i in range(len(names))]
                cols += [pa.array([p[0] for p in flat], pa.int32()), pa.array([p[1] for p in flat], pa.string()), pa.array([p[2] for p in flat], pa.string()), pa.array([p[3] for p in flat], pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, [*names, "pos", "token", "kind", "malformed"])

    return slim.mapInArrow(run, schema)
