"""Evaluation texts leaking into training text: pigeonhole edit matching.

Every run of ``min_words`` consecutive item words that a document holds with at
most ``max_edits`` word edits keeps one of the item's aligned pieces intact, if
pieces have ``(min_words + 1) // (max_edits + 2)`` words. The pieces of all
items form one Aho-Corasick automaton; a document is read once per reading of
it (as stored, and with encodings and markup undone), and each exact piece hit
is verified with Myers' bit-parallel distance over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mailtext

SCHEMA = "doc_id bigint, item_id bigint, edits int, item_word int"


def myers(pattern: list[bytes], text: list[bytes], limit: int) -> int:
    """Least edits, in words, that turn ``pattern`` into some stretch of ``text``; ``limit + 1`` if more than ``limit``."""
    m = len(pattern)
    peq: dict[bytes, int] = {}
    for k, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        best = min(best, score)
    return min(best, limit + 1)


def pieces_of(words: list[bytes], min_words: int, max_edits: int) -> list[tuple[int, bytes]]:
    """Aligned pieces with their first word's place. An item shorter than ``min_words`` counts as a whole."""
    size = max(1, (min(min_words, len(words)) + 1) // (max_edits + 2))
    return [(k, b" " + b" ".join(words[k : k + size]) + b" ") for k in range(0, len(words) - size + 1, size)]


def verified(doc: list[bytes], at: int, item: list[bytes], piece_at: int, size: int, min_words: int, max_edits: int) -> tuple[int, int] | None:
    """``(edits, item word)`` of the closest run around a piece hit, the first of several, if it is close enough."""
    m = min(min_words, len(item))
    best = None
    for a in range(max(0, piece_at + size - m), min(piece_at, len(item) - m) + 1):
        lo = at - (piece_at - a) - max_edits
        region = doc[max(0, lo) : at + (a + m - piece_at) + max_edits]
        if len(region) >= m - max_edits and (e := myers(item[a : a + m], region, max_edits)) <= max_edits and (best is None or e < best[0]):
            best = (e, a)
            if e == 0:
                break
    return best


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = 12, max_edits: int = 0, max_items: int = 50_000) -> DataFrame:
    """``doc_id, item_id, edits, item_word`` for every document that holds a run of an item's words.

    Items are a stated, small query set: more than ``max_items`` of them are
    refused, so that what is broadcast has a known bound. Null or wordless texts
    and items match nothing; repeated documents are reported each; an item held
    several times is reported once per document, with its least edits. Other
    columns are ignored. Documents are read whole, in one pass without a shuffle.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(f"`{item_id}`").cast("long"), F.col(f"`{item_text}`")).where(F.col(f"`{item_text}`").isNotNull()).limit(max_items + 1).collect()
    if len(rows) > max_items:
        raise ValueError(f"more than {max_items} items: split them into several query sets")
    known = spark.sparkContext.broadcast([(i, w) for i, t in rows if (w := mailtext.words(t).split())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        item_words = dict(known.value)
        where: dict[bytes, list[tuple[int, int]]] = {}
        for i, w in known.value:
            for k, piece in pieces_of(w, min_words, max_edits):
                where.setdefault(piece, []).append((i, k))
        machine = ahocorasick.Automaton()
        for piece in where:
            machine.add_word(piece.decode("utf-8"), piece)
        if where:
            machine.make_automaton()
        for batch in batches:
            out: dict[tuple[int, int, int], tuple[int, int]] = {}
            for n, (d, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                t = t.as_py()
                if not t or not where:
                    continue
                for reading in mailtext.readings(t):
                    s = reading.decode("utf-8", "ignore")
                    hits = list(machine.iter(s))
                    if not hits:
                        continue
                    doc = reading.split()
                    for end, piece in hits:
                        size = piece.count(b" ") - 1
                        at = s.count(" ", 0, end) - size  # words before the piece
                        for i, k in where[piece]:
                            got = out.get((n, d, i))
                            if got and got[0] == 0:
                                continue
                            v = verified(doc, at, item_words[i], k, size, min_words, max_edits)
                            if v and (not got or v < got):
                                out[(n, d, i)] = v
            keys = list(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int64()), pa.array([v[0] for v in out.values()], pa.int32()), pa.array([v[1] for v in out.values()], pa.int32())],
                ["doc_id", "item_id", "edits", "item_word"],
            )

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, SCHEMA)
