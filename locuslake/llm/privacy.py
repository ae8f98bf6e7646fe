"""Personal information inside free text: a linear-chain CRF decoded in NumPy batches.

Texts are turned into one stream of code points per batch; words, their
canonical hashes and the gaps between them come from array operations, each
distinct word's features are looked up once, and the stream is decoded in
windows that overlap by more than a mention is long. Base64 is blanked out
first, quoted-printable is decoded with a map back to the places as stored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf, labelled, mailtext

KINDS = ["email", "phone", "idno", "street", "person"]
LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
CORE, LAP = 160, 16
ESCAPES = re.compile(r"(?:=[0-9A-F]{2})+|=\r?\n(?:[>|: ]*[>|:][ \t]?)?")
EDGE = "\x03\x03\x03"

_GAP, _NEWLINE, _WORD, _MARK = 0, 1, 2, 3


def _classes() -> np.ndarray:
    """Class of every code point below 0x3000: blank, line end, letter or digit, other."""
    t = np.full(0x3000, _MARK, np.uint8)
    for c in range(0x3000):
        s = chr(c)
        if s in "\n\r\x0b\x0c\x85  ":
            t[c] = _NEWLINE
        elif s.isspace() or s in "​­":
            t[c] = _GAP
        elif s.isalnum() or 0x300 <= c < 0x370:
            t[c] = _WORD
    return t


def readable(text: str) -> tuple[str, np.ndarray | None]:
    """The text with base64 blanked and quoted-printable decoded, and each character's place as stored (None: the same)."""
    if mailtext.has_blob(text):
        lines = text.split("\n")
        for first, end in mailtext.blob_runs(lines):
            lines[first:end] = [" " * len(line) for line in lines[first:end]]
        text = "\n".join(lines)
    if "=" not in text:
        return text, None
    soft = re.search(r"=\r?\n", text)
    if not soft and not re.search(r"(?i)quoted-printable", text):
        return text, None
    parts, places, at = [], [], 0
    for m in ESCAPES.finditer(text):
        raw = m[0]
        if raw[1:2] in "\r\n":
            new = ""
        else:
            try:
                data = bytes.fromhex(raw.replace("=", ""))
                try:
                    new = data.decode("utf-8")
                except UnicodeDecodeError:
                    new = data.decode("cp1252", "replace")
            except ValueError:
                continue
        s, e = m.span()
        parts += [text[at:s], new]
        places += [np.arange(at, s), np.full(len(new), s)]
        at = e
    if not parts:
        return text, None
    parts.append(text[at:])
    places.append(np.arange(at, len(text)))
    return "".join(parts), np.concatenate(places)


class Stream:
    """Words of a batch of texts: starts and ends in the joined stream, gap before, canonical hash."""

    def __init__(self, texts: list[str], classes: np.ndarray):
        joined = EDGE + EDGE.join(texts) + EDGE
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = classes[np.minimum(cp, 0x2FFF)]
        cls = np.where(cp >= 0x3000, _WORD, cls)
        self.joined = joined
        lengths = np.array([len(t) for t in texts], np.int64)
        self.text_start = np.cumsum(lengths + 3) - lengths
        word = cls == _WORD
        before = np.concatenate([[False], word[:-1]])
        first = (word & ~before) | (cls == _MARK)
        self.start = np.nonzero(first)[0]
        solid = cls >= _WORD
        at = np.nonzero(solid)[0]
        token = np.cumsum(first)[at] - 1
        inner = (at - self.start[token]).astype(np.int64)
        self.end = np.concatenate([at[np.nonzero(np.diff(token))[0]], at[-1:]]) + 1
        c = cp[at].astype(np.uint64)
        digit = (c >= 48) & (c <= 57)
        c = np.where(digit & (inner >= 2), np.uint64(55), c)
        powers = np.power(np.uint64(6364136223846793005), np.arange(1, 65, dtype=np.uint64), dtype=np.uint64)
        h = (c + np.uint64(1)) * powers[np.minimum(inner, 63)]
        edges = np.concatenate([[0], np.nonzero(np.diff(token))[0] + 1])
        self.hash = np.add.reduceat(h, edges) if len(at) else np.zeros(0, np.uint64)
        n_digit = np.add.reduceat(digit.astype(np.int32), edges)
        size = np.diff(np.append(edges, len(at)))
        hexa = np.add.reduceat((digit | ((c >= 97) & (c <= 102)) | ((c >= 65) & (c <= 70))).astype(np.int32), edges)
        mixed = (n_digit > 0) & (n_digit < size)
        self.hash[mixed & (size >= 8) & (hexa == size)] = 1
        self.hash[mixed & (size >= 8) & (hexa < size) & (size >= 24)] = 2
        ends = np.concatenate([[0], self.end[:-1]])
        blanks = np.concatenate([[0], np.cumsum(cls == _GAP)])
        breaks = np.concatenate([[0], np.cumsum(cp == 10)])
        gap = (blanks[self.start] > blanks[ends]).astype(np.int64)
        lines = breaks[self.start] - breaks[ends]
        self.gap = np.where(lines > 1, 3, np.where(lines == 1, 2, gap))
        self.gap[cp[self.start] == 3] = 3

    def drop_quotes(self, codes: np.ndarray) -> None:
        """Take out quote marks that begin a line; the word after keeps the line break."""
        mark = np.isin(codes, (62, 124, 58)) & (self.end - self.start == 1)
        lead = mark & (self.gap >= 2)
        gap = self.gap.copy()
        while True:
            nxt = np.zeros(len(mark), bool)
            nxt[1:] = lead[:-1] & mark[1:] & (gap[1:] < 2)
            nxt &= ~lead
            if not nxt.any():
                break
            lead |= nxt
        # a run of such marks hands its line break to the first word behind it
        carried = np.where(lead & (gap >= 2), gap, 0)
        idx = np.nonzero(lead)[0]
        if len(idx):
            run_start = np.concatenate([[0], np.nonzero(np.diff(idx) > 1)[0] + 1])
            heads, tails = idx[run_start], idx[np.append(run_start[1:] - 1, len(idx) - 1)]
            follow = tails + 1
            ok = follow < len(gap)
            gap[follow[ok]] = np.maximum(gap[follow[ok]], np.maximum(2, carried[heads[ok]]))
        keep = ~lead
        self.start, self.end, self.hash, self.gap = self.start[keep], self.end[keep], self.hash[keep], gap[keep]

    def canonical(self, i: int) -> str:
        if self.hash[i] == 1:
            return "0hex0hex0hex"
        if self.hash[i] == 2:
            return "1mix" * 6
        w = self.joined[self.start[i] : self.end[i]]
        return w[:2] + re.sub("[0-9]", "7", w[2:])


def stream_of(texts: list[str], classes: np.ndarray) -> Stream:
    s = Stream(texts, classes)
    s.drop_quotes(np.frombuffer(s.joined.encode("utf-32-le", "surrogatepass"), np.uint32)[s.start])
    return s


def fit(people: list[tuple[str, str]], copies: int = 30) -> crf.Model:
    """Train on the labelled table filled with ``people``."""
    classes = _classes()
    table = labelled.examples(people, copies)
    s = stream_of([t for t, _ in table], classes)
    sentences = []
    bounds = np.searchsorted(s.start, s.text_start)
    for i, (text, spans) in enumerate(table):
        lo = bounds[i]
        hi = np.searchsorted(s.start, s.text_start[i] + len(text))
        rel = s.start[lo:hi] - s.text_start[i]
        tags = np.zeros(hi - lo, np.int64)
        for a, b, kind in spans:
            inside = np.nonzero((rel >= a) & (rel < b))[0]
            if len(inside):
                k = KINDS.index(kind)
                tags[inside] = 2 + 2 * k
                tags[inside[0]] = 1 + 2 * k
        for c in range(0, hi - lo, 60):
            e = min(hi - lo, c + 60)
            sentences.append(([s.canonical(j) for j in range(lo + c, lo + e)], s.gap[lo + c : lo + e].tolist(), tags[c:e].tolist()))
    return crf.train(sentences, LABELS)


class Tagger:
    """Decodes texts with a fitted model; keeps the score tables of the words it has met, up to a bound."""

    def __init__(self, model: crf.Model, most_words: int = 60_000):
        self.model, self.most = model, most_words
        self.classes = _classes()
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.tables = np.zeros((len(crf.OFFSETS), 0, LABELS), np.float32)
        self.rank = np.zeros(0, np.int64)

    def _rows(self, s: Stream) -> np.ndarray:
        uniq, first, inverse = np.unique(s.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, uniq)
        at[at == len(self.known)] = 0
        have = self.known[at] == uniq if len(self.known) else np.zeros(len(uniq), bool)
        if not have.all():
            if len(self.known) + (~have).sum() > self.most:
                self._forget()
                have = np.zeros(len(uniq), bool)
            new = np.nonzero(~have)[0]
            feats = np.array([crf.word_features(s.canonical(int(first[i]))) for i in new], np.int64).reshape(-1, crf.PER_WORD)
            self.tables = np.concatenate([self.tables, self.model.tables(feats)], axis=1)
            ids = np.concatenate([self.rank, np.arange(len(self.rank), len(self.rank) + len(new))])
            keys = np.concatenate([self.known, uniq[new]])
            order = np.argsort(keys)
            self.known, self.rank = keys[order], ids[order]
        return self.rank[np.searchsorted(self.known, uniq)][inverse]

    def spans(self, texts: list[str]) -> list[tuple[int, int, int, str]]:
        """(text number, start, end, kind), starts from 0 in the text as stored."""
        read = [readable(t) for t in texts]
        s = stream_of([r for r, _ in read], self.classes)
        n = len(s.start)
        if not n:
            return []
        rows = self._rows(s)
        e = crf.scores(self.tables, self.model.gap, rows, s.gap)
        lo = np.searchsorted(s.start, s.text_start)
        hi = np.append(lo[1:], n)
        counts = -(-(hi - lo) // CORE)
        own = np.repeat(np.arange(len(texts)), counts)
        begin = lo[own] + (np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)) * CORE
        tags = np.zeros(n, np.int8)
        for w in range(0, len(own), 1024):
            b = begin[w : w + 1024]
            at = b[:, None] - LAP + np.arange(CORE + 2 * LAP)[None, :]
            inside = (at >= 0) & (at < n)
            win = e[np.clip(at, 0, n - 1)]
            win[~inside] = 0
            win[~inside, 0] = 5
            got = crf.viterbi(win, self.model.step)
            core = (np.arange(CORE + 2 * LAP) >= LAP) & (np.arange(CORE + 2 * LAP) < LAP + CORE) & inside
            tags[at[core]] = got[core]
        kind = (tags.astype(np.int64) + 1) // 2  # 0 outside
        prev = np.concatenate([[0], kind[:-1]])
        begins = np.nonzero((kind > 0) & ((tags % 2 == 1) | (prev != kind)))[0]
        out = []
        ends = np.nonzero((kind > 0) & np.append((kind[1:] != kind[:-1]) | (tags[1:] % 2 == 1), True))[0]
        for b, z in zip(begins.tolist(), ends.tolist(), strict=True):
            t = int(np.searchsorted(s.text_start, s.start[b], side="right") - 1)
            x, y = int(s.start[b] - s.text_start[t]), int(s.end[z] - s.text_start[t])
            name = KINDS[kind[b] - 1]
            if x < 0 or not plausible(name, read[t][0][x:y]):
                continue
            place = read[t][1]
            if place is not None:
                y = int(place[y]) if y < len(place) else len(texts[t])
                x = int(place[x])
            out.append((t, x, y, name))
        return out


def plausible(kind: str, text: str) -> bool:
    """The exact check on a decoded mention."""
    if kind == "email":
        return "@" in text or re.search(r"(?i)[\W_]at[\W_]", text) is not None
    if kind in ("phone", "idno"):
        return sum(c.isdigit() for c in text) >= 6
    if kind == "person":
        return any(c.isupper() for c in text)
    return any(c.isdigit() for c in text)


def people_in_headers(docs: DataFrame, text: str, most_docs: int = 3000, most_names: int = 20_000) -> list[tuple[str, str]]:
    """At most ``most_names`` (given, family) names of senders and recipients in the headers of at most ``most_docs`` documents.

    The sample is the documents with the smallest text hashes, so it is the same
    whatever the partitions; it is only used to fill the labelled table.
    """
    t = F.col(f"`{text}`")
    head = F.substring_index(F.regexp_replace(t, "\r", ""), "\n\n", 1)
    sample = docs.where(t.isNotNull()).select(F.xxhash64(t).alias("h"), head.alias("head")).orderBy("h", "head").limit(most_docs)
    full = r'(?im)^(?:from|to|cc)\s*:[^\n]*?"?((?:[\p{L}\'’-]+ ){0,3}[\p{L}\'’-]+, [\p{L}-]+|[\p{L}-]+(?: [\p{L}\'’-]+){1,4})"? <'
    names = sample.select(F.explode(F.regexp_extract_all("head", F.lit(full), 1)).alias("n")).distinct().orderBy("n").limit(most_names).collect()
    out = []
    for (n,) in names:
        family, given = n.split(", ", 1) if ", " in n else (n.partition(" ")[2], n.partition(" ")[0])
        if given[:1].isupper() and family and any(c.isupper() for c in family):
            out.append((given, family))
    return out


_FITTED: dict[int, crf.Model] = {}


def find_personal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", redact: bool = False, most_docs: int = 3000, copies: int = 30) -> DataFrame:
    """``doc_id, kind, start_pos, end_pos`` of every mention, places counted from 1; with ``redact``, ``doc_id, text, n_found``.

    Null and empty texts have no mentions (and come back as they are when
    redacting); repeated rows are reported each; other columns are ignored.
    Texts are read whole. One pass, no shuffle; the model (a few megabytes,
    whatever the data) is broadcast.
    """
    spark = docs.sparkSession
    people = people_in_headers(docs, text, most_docs)
    key = hash((copies, *people))
    if key not in _FITTED:
        _FITTED.clear()
        _FITTED[key] = fit(people, copies)
    model = _FITTED[key]
    shipped = spark.sparkContext.broadcast((model.word, model.gap, model.step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = crf.Model(LABELS)
        m.word, m.gap, m.step = shipped.value
        tagger = Tagger(m)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            at = 0
            while at < len(ids):
                texts, size, first = [], 0, at
                while at < len(ids) and (size < 600_000 or not texts):
                    t = batch.column(1)[at].as_py()
                    texts.append(t)
                    size += len(t or "")
                    at += 1
                some = [i for i, t in enumerate(texts) if t]
                found = tagger.spans([texts[i] for i in some]) if some else []
                if not redact:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[first + some[t]] for t, _, _, _ in found], pa.int64()), pa.array([k for _, _, _, k in found], pa.string()), pa.array([x + 1 for _, x, _, _ in found], pa.int32()), pa.array([y for _, _, y, _ in found], pa.int32())],
                        ["doc_id", "kind", "start_pos", "end_pos"],
                    )
                    continue
                by: dict[int, list[tuple[int, int, str]]] = {}
                for t, x, y, k in found:
                    by.setdefault(some[t], []).append((x, y, k))
                new = []
                for i, t in enumerate(texts):
                    parts, end = [], 0
                    for x, y, k in by.get(i, []):
                        if x >= end:
                            parts += [t[end:x], f"[{k.upper()}]"]
                            end = y
                    new.append("".join(parts) + t[end:] if parts else t)
                yield pa.RecordBatch.from_arrays([pa.array(ids[first:at], pa.int64()), pa.array(new, pa.string()), pa.array([len(by.get(i, [])) for i in range(len(texts))], pa.int32())], ["doc_id", "text", "n_found"])

    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, text string, n_found int" if redact else "doc_id bigint, kind string, start_pos int, end_pos int")
