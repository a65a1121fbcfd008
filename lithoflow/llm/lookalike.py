"""One consistent form for texts that look the same.

Look-alike classes are the components of a union-find over code points and strings: compatibility
forms, homoglyphs, decomposed kana, blanks, and characters that are not seen (the class of the empty
string).  The member that most values of the corpus use represents its class, the ordinary one unless another is
``STRONGER`` times as frequent.  Some ordinary characters look
alike too (kana and kanji, the prolonged sound mark and the kanji for one): for these the classes are
strings, the character between its neighbours, and the corpus's most frequent string represents them.
Texts are rewritten greedily, longest pattern first, by one automaton over all patterns.

Work is done once per distinct value.  Frequencies cover all rows.  What is collected is bounded by
the character set (code points) and by the pairs of look-alikes between two neighbours (strings).

Defined results: null and blank values have no form; garbled values (see ``encoding``) are left alone
and reported by that operator; a text already in its consistent form is not reported; texts of any
length are rewritten whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoflow.functions.text import nonblank
from lithoflow.llm import encoding
from lithoflow.llm.folding import KANA_KANJI, fixed_map, is_katakana
from lithoflow.session import cut, spread

#: How many times more frequent a string must be than a look-alike string to stand for it.
STRONGER = 4


class UnionFind:
    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, a: str, b: str) -> None:
        self.up[self.find(a)] = self.find(b)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return list(out.values())


def kana_marks() -> Iterator[tuple[str, str]]:
    """(written apart, composed) of the kana with a voicing mark, full and half width."""
    for o in [*range(0x3041, 0x3097), *range(0x30A1, 0x30FB)]:
        apart = unicodedata.normalize("NFD", chr(o))
        if len(apart) == 2:
            yield apart, chr(o)
    for o in range(0xFF66, 0xFF9E):
        for mark in "ﾞﾟ":
            whole = unicodedata.normalize("NFKC", chr(o) + mark)
            if len(whole) == 1:
                yield chr(o) + mark, whole
                yield unicodedata.normalize("NFKC", chr(o)) + mark, whole


def code_point_classes() -> list[list[str]]:
    """The classes without the corpus: strings and code points that look alike whatever stands by."""
    uf = UnionFind()
    for o, plain in fixed_map().items():
        uf.union(chr(o), plain)
    for apart, whole in kana_marks():
        uf.union(apart, whole)
    for o in range(0xC0, 0x250):  # Latin letters with the accent written apart
        apart = unicodedata.normalize("NFD", chr(o))
        if len(apart) == 2:
            uf.union(apart, chr(o))
    return uf.classes()


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """Variant -> representative, over all classes; the invisible ones become ''."""
    plain = {v for v in fixed_map().values() if v and not any(ord(ch) in fixed_map() for ch in v)} | {w for _, w in kana_marks()}
    out: dict[str, str] = {}
    for members in code_point_classes():
        if "" in members:
            best = ""
        else:
            best = max(members, key=lambda m: ((counts.get(m, 0) + 1) * STRONGER if m in plain else counts.get(m, 0), m in plain, len(m) == 1, m))
        out.update({m: best for m in members if m != best and m})
    return out


def ambiguous() -> dict[str, str]:
    """Ordinary characters that look like others -> the first of their class."""
    return {ch: kana for kana, others in KANA_KANJI.items() for ch in kana + others}


def skeleton(window: str, pairs: dict[str, str]) -> str:
    return "".join(pairs.get(ch, ch) for ch in window)


def is_word(ch: str) -> bool:
    return ch.isalnum() or ch in "ー々"


class Rewriter:
    """Greedy rewriting with an automaton, then the strings of look-alikes between neighbours."""

    def __init__(self, variants: dict[str, str], strings: dict[str, str] | None = None) -> None:
        self.auto = ahocorasick.Automaton()
        for v, rep in variants.items():
            self.auto.add_word(v, (len(v), rep))
        self.auto.make_automaton()
        self.pairs = ambiguous()
        self.strings = strings or {}

    def plain(self, text: str) -> str:
        out, at = [], 0
        for end, (n, rep) in self.auto.iter_long(text):
            out += [text[at : end + 1 - n], rep]
            at = end + 1
        return "".join(out) + text[at:] if out else text

    def windows(self, text: str) -> Iterator[tuple[int, str]]:
        """(position, string) of each ambiguous character between its neighbours."""
        for i, ch in enumerate(text):
            if ch in self.pairs:
                before = text[i - 1] if i and is_word(text[i - 1]) else "^"
                after = text[i + 1] if i + 1 < len(text) and is_word(text[i + 1]) else "$"
                yield i, before + ch + after

    def form(self, text: str) -> str:
        once = self.plain(text)
        again = self.plain(once)  # marks that an invisible character kept apart
        out = list(again)
        for i, w in self.windows(again):
            if w in self.strings:
                out[i] = self.strings[w][1]
            elif is_katakana(w[0]) and is_katakana(w[2]) and not is_katakana(w[1]):
                out[i] = self.pairs[w[1]]  # no kanji stands alone inside a katakana word
        return "".join(out)


def clean_values(fields: DataFrame, known: list[str]) -> DataFrame:
    """(value, n) of the distinct values that aren't garbled, written once to the shared folder."""
    values = cut(encoding.distinct_values(fields))
    bad = encoding.judged(values, encoding.fit(values, known))
    return cut(spread(values.join(bad.select("value"), "value", "left_anti"), "value"))


def fit(values: DataFrame) -> Rewriter:
    """Representatives from the frequencies of all clean values (value, n)."""
    chars = values.select(F.explode(F.array_distinct(F.split("value", ""))).alias("c"), "n").where(F.length("c") > 0).groupBy("c").agg(F.sum("n").alias("n"))
    counts = {r[0]: r[1] for r in chars.collect()}  # at most one row for each code point there is
    variants = representatives(counts)
    pairs = ambiguous()

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Rewriter(variants)
        for b in batches:
            seen: dict[str, int] = {}
            for v, n in zip(b["value"], b["n"]):
                for _, w in own.windows(own.plain(own.plain(v))):
                    seen[w] = seen.get(w, 0) + int(n)
            yield pd.DataFrame({"w": list(seen), "skeleton": [skeleton(w, pairs) for w in seen], "n": list(seen.values())}).astype({"w": str, "skeleton": str, "n": "int64"})

    seen = cut(values.mapInPandas(windows, "w string, skeleton string, n long").groupBy("skeleton", "w").agg(F.sum("n").alias("n")))
    several = seen.groupBy("skeleton").agg(F.count(F.lit(1)).alias("forms")).where("forms > 1").select("skeleton")
    counted = {r[1]: (r[0], r[2]) for r in seen.join(several, "skeleton").select("skeleton", "w", "n").collect()}
    return Rewriter(variants, string_representatives(counted))


def string_representatives(counted: dict[str, tuple[str, int]]) -> dict[str, str]:
    """String -> the most frequent string of its class, where that is STRONGER times as frequent.  counted:
    string -> (a string it looks like, its number); strings that look like the same one are one class."""
    uf = UnionFind()
    for w, (like, _) in counted.items():
        uf.union(w, like)
    out = {}
    for members in uf.classes():
        own = [w for w in members if w in counted]
        best = max(own, key=lambda w: (counted[w][1], w))
        out |= {w: best for w in own if w != best and counted[w][1] * STRONGER <= counted[best][1]}
    return out


def forms(values: DataFrame, rewriter: Rewriter) -> DataFrame:
    """(value, form) of the distinct values that are not in their consistent form."""
    variants = {v: r for v, r in (rewriter.auto and {k: x[1] for k, x in rewriter.auto.items()}).items()}
    strings = rewriter.strings

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Rewriter(variants, strings)
        for b in batches:
            rows = [(v, f) for v in b["value"] if (f := own.form(v)) != v]
            yield pd.DataFrame(rows, columns=["value", "form"])

    return values.select("value").mapInPandas(run, "value string, form string")


def consistent(fields: DataFrame, known: list[str]) -> DataFrame:
    """(table_name, record_id, field_name, value) -> the same with ``form``, where it differs."""
    values = clean_values(fields, known)
    changed = forms(values, fit(values))
    return fields.where(nonblank("value")).drop("form").distinct().join(changed, "value")
