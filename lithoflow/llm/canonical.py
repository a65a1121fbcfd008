"""Freely typed values mapped to the entries of a canonical list.

Token-level repair.  Entries are written in several forms (Japanese, kana, English, English without
blanks); a form is its name tokens and its kind, an ending that entries share (``層群``, ``Terrace
Deposits``).  Values are cut into readings of the same make.  Every distinct token is joined to the reference
vocabulary by edit distance, as an equi-join on the strings with at most one character deleted.  The
corrected tokens of a reading are summed by soft TF-IDF against every complete form that they may stand
for: ``sum(sim * idf^2)`` over the form's tokens and the kind, divided by the lengths of both vectors.

A form is looked up by its rarest token only, so a kind or a word that hundreds of entries share never
fans out; the others are compared within the row.  Words that only qualify an entry are left out on the
way; they come from a table (``data/qualifiers.csv``).  Work is done once per distinct value.  The list
stays a table: what is collected of it is the kinds, which at least two entries share.

Defined results: null and blank values have no row; a value that is letter for letter a label has
none either; one that fits no entry is reported as ``NONE``; ties go to the smaller entry id.  Entries
without an id or without labels are never found.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import resources

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithoflow.llm.folding import BLANKS, KANA_KANJI, fold
from lithoflow.session import cut, spread

#: The least soft TF-IDF of an accepted entry, and the weight of a kind that is not the entry's.
ACCEPT, OTHER_KIND = 0.62, 2.0
#: The shortest token that may hold an error: kanji, kana, Latin letters; the shortest kind.
FUZZY_FROM, FUZZY_KIND = {"kanji": 3, "kana": 4, "latin": 3}, 3
QUOTES = re.compile(r"""^["'「『【〔]+|["'」』】〕]+$""")
BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
INNER = re.compile(r"[、,;/|・\t\n+]")
CJK = re.compile(r"[぀-ヿ一-鿿]")
PAIRS = str.maketrans({ch: kana for kana, others in KANA_KANJI.items() for ch in others})


def key_form(text: str) -> str:
    """The form in which tokens are compared: folded, lower case, kana as katakana."""
    t = fold(text).strip().lower()
    return "".join(chr(ord(ch) + 0x60) if "ぁ" <= ch <= "ゖ" else ch for ch in t)


def skeleton(text: str) -> str:
    """Look-alikes of kana and kanji as one."""
    return text.translate(PAIRS)


def within_one(a: str, b: str) -> bool:
    """One insertion, deletion, substitution or swap of neighbours, at most."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    if len(a) > len(b):
        a, b = b, a
    return a[i:] == b[i + 1 :]


def data_rows(name: str) -> list[dict[str, str]]:
    with resources.files("lithoflow.llm").joinpath("data", name).open(encoding="utf-8") as f:
        return list(csv.DictReader(f))


@dataclass(frozen=True)
class Cutter:
    """How labels and values are cut: ``endings``: written ending -> kind; ``by_kind``: kind -> its endings;
    ``qualifiers``: words left out, longest first."""

    endings: dict[str, str]
    by_kind: dict[str, tuple[str, ...]]
    qualifiers: tuple[str, ...]

    def strip(self, t: str) -> str:
        """Without qualifiers at either end."""
        again = True
        while again:
            again = False
            for q in self.qualifiers:
                if t.startswith(q) and len(t) > len(q):
                    t, again = t[len(q) :].removeprefix("ノ"), True
                    break
                if t.endswith(q) and len(t) > len(q):
                    t, again = t[: -len(q)], True
                    break
        return t

    def split_kind(self, form: str) -> tuple[int, str] | None:
        """(length of the name, kind): the longest ending that is one, else one with a single error."""
        for n in range(1, len(form)):
            if form[n:] in self.endings:
                return n, self.endings[form[n:]]
        if len(form) > FUZZY_KIND:
            last = form[-2:]
            for e, kind in self.endings.items():
                # with one error at most, one of the two last characters is among the other's
                if len(e) >= FUZZY_KIND and (e[-1] in last or e[-2] in last) and e.isascii() == form.isascii():
                    for n in (len(form) - len(e), len(form) - len(e) - 1, len(form) - len(e) + 1):
                        if 0 < n < len(form) and (" " not in form or form[n - 1] == " ") and within_one(form[n:], e):
                            return n, kind
        return None

    def readings(self, item: str) -> list[tuple[tuple[str, ...], str]]:
        """(name tokens, kind or ''); several where an item may be cut in more than one way."""
        t = key_form(item)
        whole = [t]
        if any(ch in item for ch in BLANKS):  # an odd blank may be one too many
            whole.append(key_form("".join(ch for ch in item if ch not in BLANKS)))
        t = QUOTES.sub("", t)
        bare = BRACKETS.sub("", t).strip()
        bare = re.split(r"[(\[「『\"]", bare)[0].strip() or bare
        parts = [p.strip() for p in INNER.split(bare) if p.strip()]
        whole += [bare, "".join(parts), *[p for p in parts if p not in self.qualifiers]]
        out: dict[tuple[tuple[str, ...], str], None] = {}
        for w in dict.fromkeys(x for x in whole if x):
            words = w.split()
            if CJK.search(w):
                plain = "".join(x for x in words if x not in self.qualifiers)
                for form in dict.fromkeys(map(skeleton, (plain, self.strip(plain)))):
                    if form:
                        out[((form,), "")] = None
                        got = self.split_kind(form)
                        for stem in dict.fromkeys((form[: got[0]], form[: got[0]].removesuffix("ノ"))) if got else ():
                            out[((stem,), got[1])] = None
            elif words:
                words = [x for x in words if x not in self.qualifiers] or words
                out[(tuple(words), "")] = None
                out[(("".join(words),), "")] = None
                got = self.split_kind(" ".join(words))
                if got:
                    name = " ".join(words)[: got[0]].split()
                    out[(("".join(name),), got[1])] = None
                    out[(tuple(name), got[1])] = None
        return [(name, kind) for name, kind in out if name and all(name)]

    def forms(self, kind: str, ja: str, kana: str, en: str) -> list[tuple[tuple[str, ...], str]]:
        """(name tokens, kind) of an entry in its scripts; the labels are key forms, ``kind`` the words after
        the first of the English label where these are a kind."""
        out: dict[tuple[tuple[str, ...], str], None] = {}
        for label in (ja, kana):
            own = next((e for e in self.by_kind.get(kind, ()) if not e.isascii() and label.endswith(e) and len(label) > len(e)), "")
            if label:
                out[((skeleton(label.removesuffix(own)),), kind)] = None
        if en:
            words = en.split()[:1] if kind else en.split()
            out[(tuple(words), kind)] = None
            out[(("".join(words),), kind)] = None
        return list(out)


def keyed(entries: DataFrame) -> DataFrame:
    """(ref_id, kind, ja, kana, en): the key forms of the labels; ``kind``: the words after the first of a
    unit's English label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ref, term_kind, *labels in b.itertuples(index=False):
                ja, kana, en = (key_form(x) if x else "" for x in labels)
                rows.append((ref, " ".join(en.split()[1:]) if term_kind == "unit_name" else "", ja, kana, " ".join(en.split())))
            yield pd.DataFrame(rows, columns=["ref_id", "kind", "ja", "kana", "en"])

    own = entries.where("ref_id is not null").select("ref_id", "term_kind", "label_ja", "label_kana", "label_en").distinct()
    return own.mapInPandas(run, "ref_id string, kind string, ja string, kana string, en string")


def cutter(entries: DataFrame, qualifiers: list[str] | None = None) -> Cutter:
    """From keyed entries.  A kind's endings are its English words and the suffix that all labels of the kind
    share in each script: the common beginning of the least and the greatest label read backwards."""
    words = [r["word"] for r in data_rows("qualifiers.csv")] if qualifiers is None else qualifiers
    ends = lambda c: [f(F.when(F.col(c) != "", F.reverse(c))).alias(f"{c}{k}") for k, f in enumerate((F.min, F.max))] + [F.min(F.length(c)).alias(f"{c}n")]
    shared = entries.where("kind <> ''").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *ends("ja"), *ends("kana")).where("n > 1").collect()
    endings: dict[str, str] = {}
    by_kind: dict[str, tuple[str, ...]] = {}
    for r in sorted(shared, key=lambda r: r["kind"]):
        own = []
        for c in ("ja", "kana"):
            a, b = r[f"{c}0"] or "", r[f"{c}1"] or ""
            n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            n = min(n, (r[f"{c}n"] or 1) - 1)
            if n:
                own.append(a[:n][::-1])
        by_kind[r["kind"]] = (*own, r["kind"])
        endings |= {skeleton(e): r["kind"] for e in by_kind[r["kind"]]}
    for r in data_rows("endings.csv"):
        if skeleton(r["stands_for"]) in endings:
            endings[skeleton(r["ending"])] = endings[skeleton(r["stands_for"])]
    return Cutter(endings, by_kind, tuple(sorted({key_form(q) for q in words}, key=lambda q: (-len(q), q))))


def vocabulary(entries: DataFrame, cut_by: Cutter) -> DataFrame:
    """(ref_id, kind, kind_weight, tokens: array of (term, idf), lead, norm): a row per form, with its rarest
    token as ``lead`` and the length of its vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ref, kind, ja, kana, en in b.itertuples(index=False):
                kind = kind if kind in cut_by.by_kind else ""
                whole = [((en.replace(" ", ""),), "")] if kind == "" and " " in en else []
                rows += [(ref, k, list(t)) for t, k in dict.fromkeys([*cut_by.forms(kind, ja, kana, en), *whole]) if all(t)]
            yield pd.DataFrame(rows, columns=["ref_id", "kind", "terms"])

    forms = cut(entries.mapInPandas(run, "ref_id string, kind string, terms array<string>"))
    n = forms.select("ref_id").distinct().count() or 1
    weight = lambda c: F.log(1 + F.lit(float(n)) / F.col(c))
    idf = forms.select("ref_id", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", weight("df").alias("idf"))
    kinds = forms.where("kind <> ''").select("ref_id", "kind").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("df")).select("kind", weight("df").alias("kind_weight"))
    rows = forms.withColumn("form", F.concat_ws(" ", "ref_id", "kind", F.to_json("terms"))).select("form", "ref_id", "kind", F.explode("terms").alias("term")).join(idf, "term")
    rows = rows.groupBy("form", "ref_id", "kind").agg(F.collect_list(F.struct("idf", "term")).alias("tokens")).join(kinds, "kind", "left").na.fill({"kind_weight": 0.0})
    square = F.aggregate("tokens", F.lit(0.0), lambda a, x: a + x["idf"] * x["idf"]) + F.col("kind_weight") * F.col("kind_weight")
    return cut(rows.select("ref_id", "kind", "kind_weight", "tokens", F.array_max("tokens")["term"].alias("lead"), F.sqrt(square).alias("norm"), F.lit(float(n)).alias("n_entries")))


def deletions(c: str) -> F.Column:
    """The token and the strings with one of its characters deleted."""
    n = F.length(c)
    gone = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.substring(F.col(c), F.lit(1), k - 1), F.substring(F.col(c), k + 1, n)))
    return F.array_distinct(F.concat(F.array(F.col(c)), gone))


def corrected(tokens: DataFrame, voc: DataFrame) -> DataFrame:
    """(token) joined to (term) by edit distance: (token, term, sim); an exact term shuts out others.

    Two strings at one edit share a string with at most one character deleted, so the candidates come
    from an equi-join; the distance is then measured.  A swap of neighbours counts as one edit.
    """
    least = F.when(F.col("token").rlike("^[\\x00-\\x7f]+$"), FUZZY_FROM["latin"]).when(F.col("token").rlike("^[\\x{30a1}-\\x{30ff}]+$"), FUZZY_FROM["kana"]).otherwise(FUZZY_FROM["kanji"])
    left = tokens.select("token", F.explode(F.when(F.length("token") >= least, deletions("token")).otherwise(F.array("token"))).alias("gone"))
    right = voc.select(F.col("term"), F.explode(deletions("term")).alias("gone"))
    pairs = left.join(right, "gone").select("token", "term").distinct()
    apart = F.levenshtein("token", "term", 2)
    letters = lambda c: F.array_sort(F.split(c, ""))
    swapped = (F.length("token") == F.length("term")) & (letters("token") == letters("term")) & (F.size(F.filter(F.zip_with(F.split("token", ""), F.split("term", ""), lambda x, y: x != y), lambda d: d)) == 2)
    edits = F.when(F.col("token") == F.col("term"), 0).when(apart == 1, 1).when((apart == 2) & swapped, 1)
    near = pairs.withColumn("edits", edits).where("edits is not null")
    near = near.where((F.col("edits") == 0) | ((F.length("token") >= least) & (F.length("term") >= least)))
    near = near.withColumn("least", F.min("edits").over(W.partitionBy("token"))).where("edits = least")
    return near.select("token", "term", (1 - F.col("edits") / F.greatest(F.length("token"), F.length("term"))).alias("sim"))


def sim_to(near: Column, term: Column) -> Column:
    """The best similarity of a reading's tokens to a term; null where none is near."""
    return F.array_max(F.transform(F.filter(near, lambda x: x["term"] == term), lambda x: x["sim"]))


def match(items: DataFrame, entries: DataFrame, qualifiers: list[str] | None = None) -> DataFrame:
    """(item), distinct -> (item, ref_id): the best entry of each, or ``NONE``.  ``entries``: (ref_id,
    term_kind, label_ja, label_kana, label_en)."""
    own = cut(keyed(entries))
    by = cutter(own, qualifiers)
    forms = vocabulary(own, by)

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(x, k, kind, list(name)) for x in b["item"] for k, (name, kind) in enumerate(by.readings(x))]
            yield pd.DataFrame(out, columns=["item", "reading", "kind", "name"])

    readings = cut(spread(items, "item").mapInPandas(cut_up, "item string, reading int, kind string, name array<string>"))
    tokens = readings.select("item", "reading", "kind", F.size("name").alias("n_name"), F.length(F.concat_ws("", "name")).alias("size"), F.explode("name").alias("token"))
    near = corrected(tokens.select("token").distinct(), forms.select(F.explode("tokens").alias("t")).select(F.col("t.term").alias("term")).distinct())
    held = tokens.join(near, "token").groupBy("item", "reading", "kind", "n_name", "size").agg(F.collect_list(F.struct("term", "sim")).alias("near"))
    found = held.withColumn("lead", F.explode(F.array_distinct(F.transform("near", lambda x: x["term"])))).join(forms.withColumnRenamed("kind", "own_kind"), "lead")
    sims = F.transform("tokens", lambda t: F.struct(t["idf"].alias("idf"), sim_to(F.col("near"), t["term"]).alias("sim")))
    found = found.withColumn("sims", sims).where(F.forall("sims", lambda x: x["sim"].isNotNull()))
    same = F.col("kind") == F.col("own_kind")
    total = lambda f: F.aggregate("sims", F.lit(0.0), lambda a, x: a + f(x))
    kind_item = F.when(F.col("kind") == "", 0.0).otherwise(F.when(same, F.col("kind_weight")).otherwise(OTHER_KIND))
    unmatched = F.greatest(F.lit(0), F.col("n_name") - F.size("tokens")) * F.pow(F.log(1 + F.col("n_entries")), F.lit(2.0))
    up = total(lambda x: x["sim"] * x["idf"] * x["idf"]) + F.when(same, F.pow("kind_weight", F.lit(2.0))).otherwise(0.0)
    down = F.sqrt(total(lambda x: x["idf"] * x["idf"]) + unmatched + F.pow(kind_item, F.lit(2.0))) * F.col("norm")
    scored = found.withColumn("score", up / down).where((F.col("score") >= ACCEPT) & (same | F.forall("sims", lambda x: x["sim"] == 1)))
    # the best score, then a reading with a kind, then the longest name, then the smaller id
    order = F.struct((-F.round("score", 9)).alias("score"), (F.col("kind") == "").alias("no_kind"), (-F.col("size")).alias("n"), F.col("ref_id"))
    first = scored.groupBy("item").agg(F.min(order)["ref_id"].alias("ref_id"))
    return items.join(first, "item", "left").select("item", F.coalesce("ref_id", F.lit("NONE")).alias("ref_id"))
