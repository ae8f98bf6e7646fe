"""Undoing line breaks, quote marks, markup and transfer encodings of stored mail, without trusting its headers."""

from __future__ import annotations

import binascii
import html
import quopri
import re

BASE64 = re.compile(r"[A-Za-z0-9+/]+={0,2}")
CONTROLS = bytes(c for c in range(32) if c not in (9, 10, 11, 12, 13))
#: stretches of text between other bytes, long enough for some words, in UTF-8 and in two bytes a character
TEXT_RUN = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xf4][\x80-\xbf]{1,3}){24,}")
WIDE_RUN = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){24,}")
SOFT = re.compile(r"=\r?\n|=[0-9A-F]{2}")
INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|font|a|tt|code|small|big|sub|sup|mark|wbr)(?:\s[^<>]*)?/?>", re.I)
TAG = re.compile(r"<(?:/?[A-Za-z][^<>]*|!--.*?--|![^<>]*)>", re.S)
QUOTE = re.compile(r"\n(?:[ \t]*[>|:])+[ \t]*")
#: UTF-8 forms of punctuation and blanks beyond ASCII
WIDE_MARKS = re.compile(rb"\xc2[\xa0-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb-\xbf]|\xc3[\x97\xb7]|\xe2[\x80-\xaf].|\xe3\x80[\x80-\x84\x88-\xa0]|\xef\xbb\xbf|\xef\xbf\xbd", re.S)
#: bytes that are no ASCII letter or digit become blanks; letters become lower case; bytes of other characters stay
ASCII_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def cut_blobs(text: str) -> tuple[str, list[str]]:
    """The text without its base64 runs, and the texts inside those; a run holding no text gives none."""
    lines = text.split("\n")
    rest, inside, at = [], [], 0
    for first, end in blob_runs(lines):
        rest += lines[at:first]
        inside.append(_text_of("".join(_bare(x) for x in lines[first:end])))
        at = end
    return "\n".join(rest + lines[at:]), [t for t in inside if t]


def _bare(line: str) -> str:
    return line.strip(" \t>|:\r")


def blob_runs(lines: list[str]) -> list[tuple[int, int]]:
    """First line and end of every run of base64: lines of 40 or more of its characters, or three or more
    lines of one shorter length that is a multiple of 4; and the shorter line that may end the run."""
    size = [len(s) if len(s := _bare(x)) >= 2 and " " not in s and BASE64.fullmatch(s) else 0 for x in lines]
    out, i = [], 0
    while i < len(lines):
        n, j = size[i], i
        if n >= 40:
            while j < len(lines) and size[j] >= 40:
                j += 1
        elif n >= 16 and n % 4 == 0:
            while j < len(lines) and size[j] == n:
                j += 1
            if j - i < 3:
                i = j
                continue
        else:
            i += 1
            continue
        if j < len(lines) and 2 <= size[j] < max(n, 40):
            j += 1
        out.append((i, j))
        i = j
    return out


def _text_of(body: str) -> str | None:
    """The text in a base64 body: the whole of it, or the stretches of text between bytes that are none."""
    body = body.replace("=", "")
    raw = binascii.a2b_base64(body[: len(body) - (len(body) % 4 == 1)] + "=" * (-len(body) % 4 % 3))
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff") or raw.count(0) > len(raw) // 3:
        return raw.decode("utf-16", "ignore")
    if len(raw.translate(None, CONTROLS)) >= len(raw) * 0.95:
        return raw.decode("utf-8", "ignore")
    runs = [m.decode("utf-8", "ignore") for m in TEXT_RUN.findall(raw)] + [m.decode("utf-16-le") for m in WIDE_RUN.findall(raw)]
    return "\n".join(runs) or None


def unsoft(text: str) -> str:
    """Quoted-printable undone."""
    return quopri.decodestring(text.encode("utf-8", "surrogatepass")).decode("utf-8", "ignore")


def unmark(text: str) -> str:
    """Tags and character references undone; inline tags do not part words."""
    return html.unescape(TAG.sub(" ", INLINE.sub("", text)))


def words(text: str) -> bytes:
    """Lower-case words with one blank before and after each."""
    if text.isascii():
        raw = text.encode()
    else:
        raw = text.lower().encode("utf-8", "ignore")
        if b"\xc2" in raw or b"\xe2" in raw or b"\xc3" in raw or b"\xe3" in raw or b"\xef" in raw:
            raw = WIDE_MARKS.sub(b" ", raw)
    return b" " + b" ".join(raw.translate(ASCII_WORDS).split()) + b" "


def has_blob(text: str) -> bool:
    """A line of 16 or more characters without a blank: cheap, and true of every base64 run."""
    return any(len(line) >= 16 and " " not in _bare(line) for line in text.split("\n"))


def readings(text: str) -> list[bytes]:
    """The text's words as stored and, where encodings or markup show, as they read once those are undone."""
    out = []
    texts = [text]
    if has_blob(text):
        texts[0], inside = cut_blobs(text)
        texts += inside
    for t in texts:
        if SOFT.search(t):
            out.append(words(unmark(t)))
            t = unsoft(QUOTE.sub("\n", t) if "\n> " in t else t)
        out.append(words(unmark(t) if "<" in t or "&" in t else t))
    return out
