"""Pictures and text of PDF files, read from the syntax of the format.

Files come from ``spark.read.format("binaryFile")``; one pass over each gives its streams with their
dictionaries, and from these its pictures (position, codec, size in pixels, bytes) and its text.
Everything after that (size limits, removal of copies, ranks, pages, quality) is column functions in
``operators.assets``.

There is one lexer for dictionaries and page contents: names, numbers, literal strings (nested brackets,
escapes), hexadecimal strings, arrays.  Cross-reference tables are not needed, so damaged files are read as
far as their streams are whole.

Defined results: null or empty contents have no pictures, no text and one page; a stream without an end is
left out; streams whose filters can't be undone have no text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PICTURES = "source_pdf string, offset long, filter string, filter_rank int, width_px int, height_px int, content binary, page_offsets array<long>"
TEXTS = "source_pdf string, pages_est int, text string, jbig2_scanned int, ccitt_scanned int"
#: Codecs of pictures in the order in which copies are preferred; marks of scanned pages.
CODECS = ("DCTDecode", "JPXDecode")
SCANS = (b"/JBIG2Decode", b"/CCITTFault")
#: A page object; the name ends where no letter follows, so the tree node /Pages is none.
PAGE = re.compile(rb"/Type[\0\t\n\f\r ]*/Page(?![A-Za-z])")

WHITE, DELIMITERS = b"\0\t\n\f\r ", b"()<>[]{}/%"
ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}


@dataclass(frozen=True)
class Rules:
    """How text is read where files and readers differ.  ``any_string``: strings of a text object count even
    if no operator shows them; ``utf16_hex``: a hexadecimal string is UTF-16 if it can be, whatever the
    font; ``few_escapes``: in literal strings only escaped brackets and backslashes are undone."""

    any_string: bool = True
    utf16_hex: bool = True
    few_escapes: bool = True


#: By the letter of the format.
STRICT = Rules(False, False, False)


@dataclass
class Name:
    text: str


@dataclass
class Text:
    raw: bytes
    hexadecimal: bool


@dataclass
class Operator:
    text: bytes


@dataclass
class Stream:
    """A stream: where its dictionary begins, the dictionary, the bytes as they stand."""

    at: int
    entries: dict[str, Any]
    raw: bytes
    filters: list[str] = field(default_factory=list)


def literal(data: bytes, at: int, few_escapes: bool) -> tuple[bytes, int]:
    """(bytes, end) of the literal string after the bracket at ``at``."""
    out, depth, n = bytearray(), 1, len(data)
    at += 1
    while at < n:
        c = data[at]
        if c == 0x5C and at + 1 < n:  # backslash
            d = data[at + 1]
            at += 2
            if d in b"()\\":
                out.append(d)
            elif few_escapes:
                out += bytes([c, d])
            elif d in ESCAPES:
                out.append(ESCAPES[d])
            elif 0x30 <= d <= 0x37:
                value, k = d - 0x30, 0
                while k < 2 and at < n and 0x30 <= data[at] <= 0x37:
                    value, at, k = value * 8 + data[at] - 0x30, at + 1, k + 1
                out.append(value & 0xFF)
            elif d in b"\r\n":  # the line goes on
                at += d == 13 and at < n and data[at] == 10
            else:
                out.append(d)
            continue
        depth += (c == 0x28) - (c == 0x29)
        at += 1
        if not depth:
            break
        out.append(c)
    return bytes(out), at


def lex(data: bytes, at: int, end: int, few_escapes: bool = False) -> Iterator[tuple[Any, int]]:
    """(token, end of it): numbers as they are, strings, names, operators, and brackets as operators."""
    end = min(end, len(data))
    while at < end:
        c = data[at]
        if c in WHITE:
            at += 1
        elif c == 0x25:  # a comment
            while at < end and data[at] not in b"\r\n":
                at += 1
        elif c == 0x28:
            raw, at = literal(data, at, few_escapes)
            yield Text(raw, False), at
        elif data[at : at + 2] in (b"<<", b">>"):
            at += 2
            yield Operator(data[at - 2 : at]), at
        elif c == 0x3C:
            close = data.find(b">", at)
            close = end if close < 0 else close
            digits = bytes(x for x in data[at + 1 : close] if x not in WHITE)
            at = close + 1
            if re.fullmatch(rb"[0-9A-Fa-f]*", digits):
                yield Text(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), True), at
        elif c in b"[]{}>)":
            at += 1
            yield Operator(bytes([c])), at
        else:
            start = at
            at += 1
            while at < end and data[at] not in WHITE and data[at] not in DELIMITERS:
                at += 1
            word = data[start:at]
            if c == 0x2F:
                yield Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), word[1:]).decode("latin-1")), at
                continue
            try:
                yield float(word) if b"." in word else int(word), at
            except ValueError:
                yield Operator(word), at


def dictionary(data: bytes, at: int, end: int) -> dict[str, Any]:
    """The entries of the dictionary that begins at ``at``; references to other objects are None."""
    stack: list[Any] = []
    marks: list[int] = []
    for token, _ in lex(data, at, end):
        sign = token.text if isinstance(token, Operator) else b""
        if sign in (b"<<", b"["):
            marks.append(len(stack))
        elif sign in (b">>", b"]") and marks:
            begin = marks.pop()
            items = stack[begin:]
            del stack[begin:]
            stack.append({k.text: v for k, v in zip(items[::2], items[1::2]) if isinstance(k, Name)} if sign == b">>" else items)
            if not marks:
                break
        elif sign == b"R" and len(stack) >= 2:
            stack[-2:] = [None]
        elif sign in (b"true", b"false", b"null"):
            stack.append({b"true": True, b"false": False}.get(sign))
        elif not sign:
            stack.append(token)
    return stack[0] if stack and isinstance(stack[0], dict) else {}


def opening(data: bytes, end: int) -> int:
    """Where the dictionary that closes at ``end`` begins; -1 if it doesn't."""
    depth, at = 0, end
    while True:
        a, b = data.rfind(b"<<", 0, at), data.rfind(b">>", 0, at)
        if a < 0:
            return -1
        depth += 1 if b > a else -1
        at = max(a, b)
        if depth <= 0:
            return at


def streams(data: bytes) -> Iterator[Stream]:
    """All streams with an end.  A stream's length is that of its dictionary where the keyword stands there,
    else it ends before the next keyword."""
    at = data.find(b"stream")
    while at >= 0:
        begin = at + 6
        begin += 2 if data[begin : begin + 2] == b"\r\n" else 1 if data[begin : begin + 1] == b"\n" else 0
        nxt = at + 6
        if begin > at + 6 and data[at - 3 : at] != b"end":
            close = at
            while close and data[close - 1] in WHITE:
                close -= 1
            start = opening(data, close) if data[close - 2 : close] == b">>" else -1
            entries = dictionary(data, start, close) if start >= 0 else {}
            end = data.find(b"endstream", begin)
            if end >= 0:
                length = entries.get("Length")
                stated = isinstance(length, int) and length > 0 and data[begin + length : begin + length + 12].lstrip(WHITE).startswith(b"endstream")
                raw = data[begin : begin + length] if stated else data[begin:end].rstrip(b"\r\n")
                filters = entries.get("Filter")
                filters = filters if isinstance(filters, list) else [filters]
                yield Stream(start if start >= 0 else at, entries, raw, [f.text for f in filters if isinstance(f, Name)])
                nxt = begin + len(raw) if stated else end
        at = data.find(b"stream", nxt)


def inflate(raw: bytes) -> bytes | None:
    try:
        return zlib.decompress(raw)
    except zlib.error:
        return None


def is_picture(raw: bytes, codec: str) -> bool:
    """Whether the bytes begin as the codec's do."""
    if codec == "DCTDecode":
        return raw.startswith(b"\xff\xd8\xff")
    return raw.startswith(b"\xff\x4f\xff\x51") or b"jP" in raw[:12]


def pictures(data: bytes) -> Iterator[tuple[int, str, int, int | None, int | None, bytes]]:
    """(offset, codec, rank of the codec, width, height, bytes) of each picture stream."""
    for s in streams(data):
        if not s.filters or s.filters[-1] not in CODECS or any(f != "FlateDecode" for f in s.filters[:-1]):
            continue
        raw: bytes | None = s.raw
        for _ in s.filters[:-1]:
            raw = inflate(raw) if raw is not None else None
        codec = s.filters[-1]
        if raw is not None and is_picture(raw, codec):
            width, height = (v if isinstance(v := s.entries.get(k), int) else None for k in ("Width", "Height"))
            yield s.at, codec, CODECS.index(codec), width, height, raw


def characters(t: Text, rules: Rules) -> str:
    """What a string says; fonts are not looked up."""
    if t.raw.startswith(b"\xfe\xff"):
        return t.raw[2:].decode("utf-16-be", "ignore")
    if t.hexadecimal and rules.utf16_hex:
        try:
            return t.raw.decode("utf-16-be")
        except UnicodeDecodeError:
            pass
    return t.raw.decode("latin-1")


def shown_text(content: bytes, rules: Rules) -> str:
    """The strings of the text objects of a page's content, in order."""
    out: list[str] = []
    held: list[str] = []
    inside = False
    for token, _ in lex(content, 0, len(content), rules.few_escapes):
        if isinstance(token, Text):
            if inside:
                held.append(characters(token, rules))
        elif isinstance(token, Operator) and token.text not in (b"[", b"]"):
            if token.text in (b"BT", b"ET"):
                inside = token.text == b"BT"
            if rules.any_string or token.text in (b"Tj", b"TJ", b"'", b'"'):
                out += held
            held = []
    return "".join(out)


def page_text(data: bytes, rules: Rules = Rules()) -> str:
    """The text of all deflated streams that hold text objects, a line per stream."""
    lines = []
    for s in streams(data):
        if all(f == "FlateDecode" for f in s.filters):
            content = inflate(s.raw)
            if content is not None and b"BT" in content:
                line = shown_text(content, rules)
                if line.strip():
                    lines.append(line)
    return "\n".join(lines)


def read_files(spark, path: str, pattern: str = "*.pdf") -> DataFrame:  # noqa: ANN001
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("source_pdf"), "content")


def extract_pictures(files: DataFrame) -> DataFrame:
    """One row per picture of (source_pdf, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["source_pdf"], b["content"]):
                data = data or b""
                pages = [m.start() for m in PAGE.finditer(data)]
                rows = [(name, *p, pages) for p in pictures(data)]
                yield pd.DataFrame(rows, columns=["source_pdf", "offset", "filter", "filter_rank", "width_px", "height_px", "content", "page_offsets"]).astype({"width_px": "Int32", "height_px": "Int32"})

    return files.mapInPandas(run, PICTURES)


def extract_texts(files: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per file: estimated pages (1 at least), text, counts of pages that are scans."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, data in zip(b["source_pdf"], b["content"]):
                data = data or b""
                rows.append((name, max(1, len(PAGE.findall(data))), page_text(data, rules), *[data.count(mark) for mark in SCANS]))
            yield pd.DataFrame(rows, columns=["source_pdf", "pages_est", "text", "jbig2_scanned", "ccitt_scanned"])

    return files.mapInPandas(run, TEXTS)
