"""Texts decoded with the wrong character encoding: which they are, and what they were.

Noisy-channel decoding.  A value is a lattice: of its characters as they stand, and, around odd ones, of
the bytes they were shown from, in which a lost character is a wildcard for one byte or two and a
character with two codes has both.  A Viterbi search over words and characters with their corpus
frequencies finds the likeliest text that fits; it chooses which spans are read as they stand and which
from their bytes, so a value may hold several damaged spans.  The corpus is the fields themselves: a text is
told to be damaged when the restored reading is far likelier under those frequencies than the text as
it stands, or when it holds characters only a wrong decoding leaves (U+FFFD, C1 controls, private use).

Work is done once per distinct value: values whose characters all occur in frequent words are set
aside by a column expression, the others are tested in Arrow batches, and what is found goes back to
the records by a join on the value.  Word and character statistics cover all rows; what is sent to the
workers is the words above a share of all tokens (so at most 1/share of them).

Defined results: null and blank values are never damaged; texts of any length are tested whole; a
value with no likely reading is reported with ``restored`` null.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoflow.functions.text import nonblank
from lithoflow.llm.folding import BLANKS, INVISIBLE_RANGES, fold
from lithoflow.session import cut, spread

LOST = "\ufffd"
#: Fixed values: (encoding it was read in, encoding it was in); a|b|a: written in a, read in b, written again.
PAIRS = (
    ("cp1252", "utf-8"), ("latin-1", "utf-8"), ("mac_roman", "utf-8"), ("cp1251", "utf-8"), ("koi8_r", "utf-8"), ("cp932", "utf-8"), ("gbk", "utf-8"), ("euc_jp", "utf-8"), ("big5", "utf-8"),
    ("cp1252", "cp932"), ("latin-1", "cp932"), ("mac_roman", "cp932"), ("cp1251", "cp932"), ("koi8_r", "cp932"), ("gbk", "cp932"), ("euc_jp", "cp932"), ("utf-8", "cp932"),
    ("cp1252", "utf-8|cp1252|utf-8"), ("cp1252", "utf-8|latin-1|utf-8"), ("latin-1", "utf-8|cp1252|utf-8"), ("latin-1", "utf-8|latin-1|utf-8"),
    ("cp1252", "euc_jp"), ("latin-1", "euc_jp"), ("mac_roman", "euc_jp"), ("cp1251", "euc_jp"), ("koi8_r", "euc_jp"), ("cp932", "euc_jp"), ("gbk", "euc_jp"), ("utf-8", "euc_jp"),
)
#: Those of which the reverse is no damage: text read rightly has no such reading.
ONE_WAY = tuple(p for p in PAIRS if p[::-1] not in PAIRS)
#: Words and characters with at least this share of all tokens make the language model.
WORD_SHARE, CHAR_SHARE = 2e-5, 1e-6
#: A value is safe when all its characters occur in the reference list, or in words with at least this
#: share that have no likelier reading.
SAFE_SHARE = 3e-4
#: How much likelier (in nats) the restored reading must be besides what each span read from bytes costs,
#: and what a word with an unsafe character loses when the text is read as it stands: one repeated in its
#: garbled form is no evidence for it.
MARGIN, SWITCH, UNSAFE_WORD = 2.0, 2.0, 6.0
#: What a character loses beside a word, so that words are preferred.
CHAR = math.log(0.05)
#: Characters this near to an odd one may belong to its damage, as bytes may look plain.
BESIDE = 2
FLOOR = math.log(1e-9)
HALF_WIDTH = re.compile("[\uff66-\uff9f]+")
TOKEN_SPLIT = r"[、,，､;；/／|｜・･\t\n\r+\-()（）「」\"\s]+|及び|並びに"


@lru_cache(64)
def byte_table(shown: str) -> dict[str, bytes]:
    """Private-use and control characters that decoders show for bytes the code page leaves free."""
    out: dict[str, bytes] = {}
    if shown in ("cp1252", "cp1251", "mac_roman", "koi8_r"):
        for b in range(0x80, 0x100):
            try:
                bytes([b]).decode(shown)
            except UnicodeDecodeError:
                out[chr(b)] = bytes([b])
        if shown == "cp1252":
            out.update({chr(b): bytes([b]) for b in range(0x80, 0xA0)})
    elif shown == "cp932":
        for k in range(10 * 188):
            lead, at = divmod(k, 188)
            out[chr(0xE000 + k)] = bytes([0xF0 + lead, at + 0x40 + (at >= 63)])
        out.update({"\uf8f0": b"\xa0", "\uf8f1": b"\xfd", "\uf8f2": b"\xfe", "\uf8f3": b"\xff", "\x80": b"\x80"})
    return out


@lru_cache(200_000)
def to_bytes(ch: str, shown: str) -> bytes | None:
    try:
        return ch.encode(shown)
    except UnicodeEncodeError:
        if shown == "gbk":  # its later edition has the same two-byte codes, and some more
            b = ch.encode("gb18030") if not "\ud800" <= ch <= "\udfff" else b""
            return b if len(b) == 2 else None
        return byte_table(shown).get(ch)


@lru_cache(None)
def other_codes(shown: str) -> dict[str, bytes]:
    """Characters with a second code in a code page, which encoding does not give."""
    out: dict[str, bytes] = {}
    if shown == "cp932":
        for lead in (0x81, 0x87, 0xED, 0xEE):
            for trail in range(0x40, 0xFD):
                raw = bytes([lead, trail])
                try:
                    ch = raw.decode(shown)
                except UnicodeDecodeError:
                    continue
                if len(ch) == 1 and ch.encode(shown) != raw:
                    out[ch] = raw
    return out


@lru_cache(200_000)
def codes(ch: str, shown: str) -> tuple[bytes, ...]:
    """All bytes a character may have been shown from; none if the code page lacks it."""
    first = to_bytes(ch, shown)
    second = other_codes(shown).get(ch)
    return () if first is None else (first,) if second is None else (first, second)


@lru_cache(8)
def single_bytes(shown: str) -> list[str]:
    """The characters that a single-byte code page shows for each byte."""
    own = {b[0]: ch for ch, b in byte_table(shown).items()}
    return [bytes([x]).decode(shown, "ignore") or own[x] for x in range(256)]


def encode(text: str, enc: str) -> bytes | None:
    """The bytes of a text; for ``a|b|a`` those of its garbled form.  None where it has none."""
    first, *more = enc.split("|")
    try:
        raw = text.encode(first)
        for read, again in zip(more[::2], more[1::2]):
            raw = "".join(map(single_bytes(read).__getitem__, raw)).encode(again)
    except UnicodeError:
        return None
    return raw


@dataclass
class Model:
    """Log probabilities of words and characters, and tries and tables of their bytes."""

    words: dict[str, float]
    chars: dict[str, float]
    safe: frozenset[str]
    tries: dict[str, dict] = field(default_factory=dict)
    tables: dict[str, Table] = field(default_factory=dict)
    kept: dict[str, float] = field(default_factory=dict)
    longest: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for w in self.words:  # the length of the longest word that begins with a character
            self.longest[w[0]] = max(len(w), self.longest.get(w[0], 0))

    def entries(self, enc: str) -> Iterator[tuple[float, str, bytes]]:
        """(log probability, text, bytes) of what a damaged span may be read as: words and characters in
        their ordinary form."""
        chars = {c: FLOOR for c in self.safe if c not in self.chars} | {c: lp + CHAR for c, lp in self.chars.items()}
        for source in (self.words, chars):
            for text, lp in source.items():
                raw = encode(text, enc)
                if raw and fold(text) == text:
                    yield lp, text, raw

    def ready(self) -> Model:
        """With all tries and tables built, so that words taken out later stay readings."""
        for enc in dict.fromkeys(p[1] for p in PAIRS):
            self.trie(enc), self.table(enc)
        return self

    def trie(self, enc: str) -> dict:
        """Bytes -> ... -> {None: (text, log probability)}."""
        if enc not in self.tries:
            root: dict = {}
            for lp, text, raw in self.entries(enc):
                node = root
                for b in raw:
                    node = node.setdefault(b, {})
                if None not in node or node[None][1] < lp:
                    node[None] = (text, lp)
            self.tries[enc] = root
        return self.tries[enc]

    def table(self, enc: str) -> Table:
        if enc not in self.tables:
            self.tables[enc] = Table(sorted(self.entries(enc), reverse=True))
        return self.tables[enc]

    def pieces(self, text: str, i: int) -> Iterator[tuple[int, float]]:
        """(end, log probability) of the words and the character at i, read as they stand."""
        lp = self.chars.get(text[i])
        yield i + 1, CHAR + lp if lp is not None else FLOOR
        for j in range(i + 1, min(len(text), i + self.longest.get(text[i], 0)) + 1):
            lp = self.words.get(text[i:j])
            if lp is not None:
                yield j, lp if self.safe.issuperset(text[i:j]) else lp - UNSAFE_WORD

    def score(self, text: str) -> float:
        """The log probability of the likeliest cut of a text into words and characters."""
        if text in self.kept:
            return self.kept[text]
        best = [0.0] + [-math.inf] * len(text)
        for i in range(len(text)):
            for j, lp in self.pieces(text, i):
                if best[i] + lp > best[j]:
                    best[j] = best[i] + lp
        if len(self.kept) < 50_000:
            self.kept[text] = best[-1]
        return best[-1]


#: Code pages in which a mark may stand for two bytes: the first and the second.
ANY = range(0x80, 0x100)
DOUBLES = {"utf-8": (range(0xE0, 0xF5), range(0x80, 0xC0)), "cp932": (ANY, range(256)), "gbk": (ANY, range(256)), "euc_jp": (ANY, range(256)), "big5": (ANY, range(256))}
DOUBLE = 4.0
#: The bits of a search's state: so many units of the lattice lie ahead of where a word begins.
AHEAD = 62


class Table:
    """Words and characters as rows of bytes, likeliest first, for lattices with lost bytes: all rows are
    followed through the lattice at once, as sets of the units where each may stand.  (Words of more than
    AHEAD bytes are read in parts there.)"""

    def __init__(self, entries: list[tuple[float, str, bytes]]) -> None:
        entries = [e for e in entries if len(e[2]) <= AHEAD]
        self.lps, self.texts = [e[0] for e in entries], [e[1] for e in entries]
        self.size = np.array([len(e[2]) for e in entries], np.int64)
        width = int(self.size.max()) if len(entries) else 1
        self.raw = np.zeros((len(entries), width), np.uint8)
        for k, (_, _, raw) in enumerate(entries):
            self.raw[k, : len(raw)] = np.frombuffer(raw, np.uint8)
        self.by_first = [np.flatnonzero(self.raw[:, 0] == b) for b in range(256)]
        self.high = np.flatnonzero(self.raw[:, 0] >= 0x80)
        self.kept: dict[tuple, list[tuple[int, float, str]]] = {}

    def follow(self, ahead: tuple[Any, ...], shown: str) -> list[tuple[int, float, str]]:
        """(units taken, log probability, text): the likeliest row for each number of units.  A unit is the
        set of the bytes it may be, or None for a mark, which stands for a byte that is no ASCII or for two:
        in UTF-8 for the beginning of a longer character, in other code pages of two bytes for any (a word
        for which that is needed loses DOUBLE)."""
        first, second = DOUBLES.get(shown, (range(0), range(0)))
        key = (ahead, first)
        if key not in self.kept:
            found = self.search(ahead, first, second)
            if first == ANY:
                once = self.search(ahead, range(0), range(0)) if found else {}
                rated = {k: max([(self.lps[r] - DOUBLE, r), *([(self.lps[once[k]], once[k])] if k in once else [])]) for k, r in found.items()}
                hits = [(k, lp, self.texts[r]) for k, (lp, r) in rated.items()]
            else:
                hits = [(k, self.lps[r], self.texts[r]) for k, r in found.items()]
            if len(self.kept) >= 20_000:
                self.kept.clear()
            self.kept[key] = sorted(hits)
        return self.kept[key]

    def search(self, ahead: tuple[Any, ...], first: range, second: range) -> dict[int, int]:
        """Units taken -> the likeliest row that takes them."""
        known = np.zeros(256, np.uint64)
        marks = np.uint64(0)
        for k, unit in enumerate(ahead):
            if unit is None:
                marks |= np.uint64(1 << k)
            else:
                known[list(unit)] |= np.uint64(1 << k)
        high, begins, ends_it = np.zeros((3, 256), np.uint64)
        high[0x80:], begins[first.start : first.stop], ends_it[second.start : second.stop] = marks, marks, marks
        takes = known | high
        rows = self.high if ahead[0] is None else np.sort(np.concatenate([self.by_first[b] for b in ahead[0]])) if ahead[0] else self.high[:0]
        at, half = np.full(len(rows), 1, np.uint64), np.zeros(len(rows), np.uint64)
        best: dict[int, int] = {}
        for t in range(self.raw.shape[1]):
            if not len(rows):
                break
            b = self.raw[rows, t]
            at, half = ((at & takes[b]) | (half & ends_it[b])) << np.uint64(1), at & begins[b]
            ends = self.size[rows] == t + 1
            done = np.flatnonzero(ends)
            if len(done):  # in order of likelihood, so only rows that end where none before them did count
                so_far = np.bitwise_or.accumulate(at[done])
                for j in np.flatnonzero(so_far[1:] != so_far[:-1]).tolist() + [-1]:
                    row, state = int(rows[done[j + 1]]), int(so_far[j + 1]) & ~(int(so_far[j]) if j >= 0 else 0)
                    while state:
                        k = (state & -state).bit_length() - 1
                        state &= state - 1
                        if k not in best or row < best[k]:
                            best[k] = row
            go = ~ends & ((at | half) > 0)
            rows, at, half = rows[go], at[go], half[go]
        return best


def zone(value: str, model: Model) -> list[bool]:
    """Which characters may be part of a damaged span."""
    odd = [ch not in model.safe for ch in value]
    return [any(odd[max(0, i - BESIDE) : i + BESIDE + 1]) for i in range(len(value))]


@dataclass
class Lattice:
    """The units (sets of bytes, None for a mark) of the characters in the zone; ``first``: character ->
    its first unit; ``char``: unit -> the character that begins there; ``stop``: unit -> where the span of
    units it is in ends; ``tail``: a unit that may be missing at the end."""

    units: list[frozenset[int] | None]
    first: dict[int, int]
    char: dict[int, int]
    stop: list[int]
    tail: bool
    paired: bool = False


def lattice(value: str, inside: list[bool], shown: str, tail: bool) -> Lattice:
    """Characters of the zone that the code page lacks end a span of units."""
    units: list[frozenset[int] | None] = []
    first, char, spans = {}, {}, []
    begin, paired = 0, False
    for i, ch in enumerate(value + "\0"):
        own = codes(ch, shown) if i < len(value) and inside[i] and ch != LOST else ()
        if i < len(value) and inside[i] and (own or ch == LOST):
            first[i], char[len(units)] = len(units), i
            paired |= len(own) > 1
            units += [None] if ch == LOST else [frozenset(bs) for bs in zip(*own)]
            continue
        if len(units) > begin:
            if i == len(value) and tail:
                units.append(None)
            char[len(units)] = i
            spans += [len(units)] * (len(units) + 1 - begin)
            units.append(frozenset())  # between two spans
            begin = len(units)
    return Lattice(units, first, char, spans, tail, paired)


def viterbi(value: str, inside: list[bool], model: Model, shown: str, enc: str, stand: list[list[tuple[int, float]]] | None = None) -> tuple[float, str, list[tuple[str, str]]] | None:
    """(log probability, text, damaged spans as (shown, restored)) of the likeliest path through the
    lattice of a value; None if none reads a span from its bytes.  ``stand``: the value's pieces as they
    stand, if known."""
    stand = [list(model.pieces(value, i)) for i in range(len(value))] if stand is None else stand
    lat = lattice(value, inside, shown, sure(value) and LOST not in value)
    root = model.trie(enc)
    n, n_units = len(value), len(lat.units)
    # (log probability, previous state, text); a state is a character boundary or a unit within a span
    plain: list[tuple[float, Any, str] | None] = [None] * (n + 1)
    inner: list[tuple[float, Any, str] | None] = [None] * (n_units + 1)
    plain[0] = (0.0, None, "")
    for i in range(n + 1):
        if plain[i] is not None and i < n:
            base = plain[i][0]
            for j, lp in stand[i]:
                if plain[j] is None or base + lp > plain[j][0]:
                    plain[j] = (base + lp, ("c", i), value[i:j])
        if i not in lat.first:
            continue
        # the units from this character up to the next one
        stop = lat.stop[lat.first[i]]
        last = lat.first.get(i + 1, stop)
        for u in range(lat.first[i], last):
            state, came = inner[u], ("u", u)
            if u == lat.first[i] and plain[i] is not None and (state is None or plain[i][0] - SWITCH > state[0]):
                state, came = (plain[i][0] - SWITCH, None, ""), ("c", i)
            if state is None:
                continue
            node, v = root, u
            hits: list[tuple[int, float, str]] = []
            while v < stop:
                unit = lat.units[v]
                if unit is None or len(unit) > 1:
                    hits = [(u + k, lp, text) for k, lp, text in model.table(enc).follow(tuple(lat.units[u : min(stop, u + AHEAD)]), shown)]
                    break
                (b,) = unit
                node = node.get(b)
                if node is None:
                    break
                v += 1
                if None in node:
                    hits.append((v, node[None][1], node[None][0]))
            for v, lp, text in hits:
                if inner[v] is None or state[0] + lp > inner[v][0]:
                    inner[v] = (state[0] + lp, came, text)
                if lat.tail and v == stop - 1 and lat.char[stop] == n:
                    if inner[stop] is None or state[0] + lp > inner[stop][0]:
                        inner[stop] = (state[0] + lp, came, text)
        end = lat.char.get(last)
        if end is not None and inner[last] is not None and (plain[end] is None or inner[last][0] > plain[end][0]):
            plain[end] = (inner[last][0], ("u", last), "")
    if plain[n] is None:
        return None
    pieces: list[str] = []
    spans: list[tuple[str, str]] = []
    state, read, to = ("c", n), "", n
    while state is not None:
        kind, k = state
        lp, back, text = plain[k] if kind == "c" else inner[k]
        pieces.append(text)
        if kind == "c" and back is not None and back[0] == "u":
            read, to = "", k
        if kind == "u":
            read = text + read
            if back[0] == "c":
                spans.append((value[back[1] : to], read))
        state = back
    spans = spans[::-1]
    if not spans or (lat.paired and not all(again(text, enc, shown) == was for was, text in spans)):
        return None
    return plain[n][0], "".join(reversed(pieces)), spans


def again(text: str, enc: str, shown: str) -> str | None:
    """The text as the wrong decoding shows it."""
    raw = encode(text, enc)
    return raw.decode(shown, "replace") if raw is not None else None


def sure(value: str) -> bool:
    return any(ch == LOST or "\x80" <= ch <= "\x9f" and ch != "\x85" or "\ue000" <= ch <= "\uf8ff" for ch in value)


def foreign_run(value: str, model: Model) -> bool:
    """Two neighbouring signs of single-byte code pages that no word of the corpus has, or half-width
    kana that make no word, beside an unsafe kanji."""
    for m in HALF_WIDTH.finditer(value):
        sides = value[max(0, m.start() - 1) : m.start()] + value[m.end() : m.end() + 1]
        if any("\u4e00" <= y <= "\ufaff" and y not in model.safe for y in sides) and fold(m[0]) not in model.words:
            return True
    run = 0
    for ch in value:
        o = ord(ch)
        run = run + 1 if ch not in model.safe and (0xA1 <= o <= 0x24F and o != 0xAD or 0x2010 <= o <= 0x22FF or 0x400 <= o <= 0x52F) else 0
        if run > 1 and fold(ch) == ch:
            return True
    return False


def likely(value: str, inside: list[bool], model: Model, shown: str) -> bool:
    """Without lost bytes, UTF-8 can be told at once: bytes of another text rarely make its characters."""
    raw = b"".join(to_bytes(ch, shown) or b"" for ch, z in zip(value, inside) if z)
    read = raw.decode("utf-8", "ignore")
    return any(ch in model.chars or ch in model.safe for ch in read if not ch.isascii())


def read_one(value: str, model: Model, pairs: tuple[tuple[str, str], ...] = PAIRS) -> tuple[float, str, str] | None:
    """(gain, restored, way) of the best reading that is likelier than the value by MARGIN."""
    odd = [ch for ch in value if ch not in model.safe and ch != LOST]
    lost = LOST in value
    if not odd and not lost:
        return None
    best: tuple[float, str, str] | None = None
    whole = model.score(fold(value))
    inside = zone(value, model)
    stand = [list(model.pieces(value, i)) for i in range(len(value))]
    able: dict[str, bool] = {}
    for shown, enc in pairs:
        if shown not in able:
            # lost marks among plain characters only are what a failed reading as UTF-8 leaves
            able[shown] = (bool(odd) or shown == "utf-8") and any(to_bytes(ch, shown) is not None for ch in odd or "a")
            able[f"{shown} utf-8"] = able[shown] and (lost or sure(value) or likely(value, inside, model, shown))
        if not able.get(f"{shown} {enc}", able[shown]):
            continue
        got = viterbi(value, inside, model, shown, enc, stand)
        if got and got[0] - whole > MARGIN and (best is None or got[0] - whole > best[0]) and got[1] != value:
            best = (got[0] - whole, got[1], f"{enc} as {shown}")
    return best


def judge(value: str, model: Model) -> tuple[bool, str | None, str | None, float | None]:
    """(damaged, restored, way, gain) of a value."""
    best = read_one(value, model)
    if best:
        return True, best[1], best[2], best[0]
    return sure(value) or foreign_run(value, model), None, None, None


def plain_chars() -> str:
    """Characters no reading is tried for: ASCII, kana, Japanese signs, and what only looks odd."""
    keep = [chr(c) for c in range(0x20, 0x7F)] + list("\t\n\r") + [chr(c) for c in range(0x3041, 0x3097)] + [chr(c) for c in range(0x3099, 0x309B)] + [chr(c) for c in range(0x30A1, 0x30FD)] + list("、。「」『』【】〔〕々〆及並")
    keep += [chr(c) for c in range(0xFF01, 0xFF5F)] + [chr(c) for c in range(0x2E80, 0x2FD6)] + [chr(c) for c in range(0xF900, 0xFB00)] + list(BLANKS)
    keep += [chr(c) for a, b in INVISIBLE_RANGES for c in range(a, b + 1) if c != 0xAD]
    return "".join(keep)


def distinct_values(fields: DataFrame) -> DataFrame:
    return fields.where(nonblank("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def fit(values: DataFrame, known: list[str]) -> Model:
    """Word and character frequencies over all rows of (value, n).  Tokens with U+FFFD, controls or
    private-use characters are no words, nor are frequent ones with a likelier reading.  ``known``: words counted besides (a reference list)."""
    text = values.where(~F.col("value").rlike(r"[\x{FFFD}\x{80}-\x{9F}\x{E000}-\x{F8FF}]"))
    tokens = text.select(F.explode(F.split("value", TOKEN_SPLIT)).alias("w"), "n").where(F.length("w") > 0)
    words = tokens.groupBy("w").agg(F.sum("n").alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 1
    frequent = {r[0]: r[1] for r in words.where(F.col("n") >= max(2, total * WORD_SHARE)).collect()}
    chars = text.select(F.explode(F.split("value", "")).alias("c"), "n").where(F.length("c") > 0).groupBy("c").agg(F.sum("n").alias("n"))
    n_chars = chars.agg(F.sum("n")).first()[0] or 1
    letters = {r[0]: r[1] for r in chars.where(F.col("n") >= max(2, n_chars * CHAR_SHARE)).collect()}
    base = frozenset(plain_chars()) | {ch for w in known for ch in w}
    least = max(2, total * SAFE_SHARE)
    often = {r[0]: r[1] for r in text.where(F.col("n") >= least).collect()}
    for v in repeated_garble(list(often), frequent, known, base):  # no evidence of words or characters
        n = often[v]
        for w in re.split(TOKEN_SPLIT, v, flags=re.ASCII):
            if w in frequent:
                frequent[w] -= n
        for ch in v:
            if ch in letters:
                letters[ch] -= n
    frequent = {w: n for w, n in frequent.items() if n >= max(2, total * WORD_SHARE)}
    # garbled words spread over many values, none of which is frequent itself
    for w in repeated_garble([w for w, n in frequent.items() if n >= least and len(w) > 1], frequent, known, base):
        n = frequent.pop(w)
        for ch in w:
            if ch in letters:
                letters[ch] -= n
    letters = {ch: n for ch, n in letters.items() if n >= max(2, n_chars * CHAR_SHARE)}
    safe = base | {ch for w, n in frequent.items() if n >= least and len(w) > 1 for ch in w if "\u4e00" <= ch <= "\u9fff"}
    for w in known:
        frequent[w] = frequent.get(w, 0) + 2
        for ch in w:
            letters[ch] = letters.get(ch, 0) + 2
    return Model({w: math.log(n / total) for w, n in frequent.items()}, {c: math.log(n / n_chars) for c, n in letters.items()}, frozenset(safe))


def repeated_garble(texts: list[str], frequent: dict[str, int], known: list[str], base: frozenset[str]) -> list[str]:
    """Those of the frequent texts (at most 1/SAFE_SHARE) that have a likelier reading.  How often a text
    is repeated says nothing for it: words count only if all their characters are in ``base`` (the
    reference list and plain ones), and characters count by the distinct words that have them.  Where the
    pair of encodings is one-way, all words but the text's own count for the other reading."""
    suspects = [t for t in texts if not base.issuperset(t)]
    if not suspects:
        return []
    counts = Counter(frequent)
    for w in known:
        counts[w] += 2
    kinds = Counter(ch for w in counts for ch in set(w))
    chars = {c: math.log(n / kinds.total()) for c, n in kinds.items()}
    words = {w: math.log(n / counts.total()) for w, n in counts.items() if n > 0}
    strict_model, model = Model({w: lp for w, lp in words.items() if base.issuperset(w)}, chars, base), Model(words, chars, base).ready()
    out = []
    for t in suspects:
        own = {w: words.pop(w) for w in {t, *re.split(TOKEN_SPLIT, t, flags=re.ASCII)} if w in words}
        model.kept.clear()
        if read_one(t, strict_model) or read_one(t, model, ONE_WAY):
            out.append(t)
        words |= own
    return out


def damaged(fields: DataFrame, known: list[str]) -> DataFrame:
    """(record_id, field_name, value) -> (value, restored, way, gain): the distinct damaged values."""
    values = cut(distinct_values(fields))
    return judged(values, fit(values, known))


_SHARED: dict[str, Model] = {}


def shared(key: str, words: dict[str, float], chars: dict[str, float], safe: frozenset[str]) -> Model:
    """The model of a worker process, whose tries serve all its tasks; only the last one is kept."""
    if key not in _SHARED:
        _SHARED.clear()
        _SHARED[key] = Model(words, chars, safe)
    return _SHARED[key]


def judged(values: DataFrame, model: Model) -> DataFrame:
    safe = "".join(sorted(model.safe))
    sent = (uuid.uuid4().hex, model.words, model.chars, model.safe)
    odd = spread(values.where(F.length(F.translate("value", safe, "")) > 0).select("value"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared(*sent)
        for b in batches:
            rows: list[tuple[Any, ...]] = []
            for v in b["value"]:
                is_damaged, restored, way, gain = judge(v, own)
                if is_damaged:
                    rows.append((v, restored, way, gain))
            yield pd.DataFrame(rows, columns=["value", "restored", "way", "gain"]).astype({"gain": "float64"})

    return odd.mapInPandas(run, "value string, restored string, way string, gain double")


def restore(fields: DataFrame, known: list[str]) -> DataFrame:
    """(record_id, field_name, value, restored, way, gain) of the records with a damaged value.  The distinct
    values are written once; the fields are read again only for the join."""
    values = cut(distinct_values(fields))
    model = fit(values, known)
    safe = "".join(sorted(model.safe))
    odd = fields.where(nonblank("value") & (F.length(F.translate("value", safe, "")) > 0)).select("record_id", "field_name", "value").distinct()
    return odd.join(judged(values, model), "value").select("record_id", "field_name", "value", "restored", "way", "gain")
