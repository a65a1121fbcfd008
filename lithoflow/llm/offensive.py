"""Abusive, hateful and sexual language: a score for every document, the sentences it comes from, and
rates per source.

Multiple-instance learning.  A document is a bag of sentences; a sentence's probability comes from the
weights of its character n-grams, and the document's is the noisy-or of its sentences.  Only documents
are labelled; training them through the noisy-or finds the sentences that carry the label.  Weights
are not negative, so plain text around an offending phrase cannot hide it; what also occurs in clean
documents gets no weight.

Disguises are undone before the n-grams are taken: case, width, look-alikes, digits and signs for
letters, stretched and spaced-out words, invisible characters.  Signs in place of letters become one
mask sign.

Training uses a bounded sample of labelled rows (``Sample``), drawn by a hash of the id, and the document
frequencies of its n-grams over all documents, in one aggregated pass.  Scoring covers every document and
its whole text.  Texts stay on the executors, in Arrow batches with array operations; what comes to the
driver is the n-grams that tell (each seen in a labelled offending document) and where the labelled
documents have them.

Defined results: null and empty texts have score 0 and no sentence; repeated texts are scored under
each id.  What is learnt comes from the labels alone, by the same steps at every size: without any
offending label nothing is known and all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoflow.llm.folding import fixed_map
from lithoflow.session import cut

BITS = 20
SIZES = (2, 3, 4, 5)
#: The probability from which a sentence is offending: low, as the weights are held down by their penalty.
OFFENDS = 0.2
#: A sentence without any n-gram that tells has this logit; how many times as frequent an n-gram that tells
#: is in offending documents.
BIAS, RATIO = -6.0, 6.0


@dataclass(frozen=True)
class Sample:
    """At most so many labelled offending and labelled clean documents are learnt from."""

    offending: int = 2000
    clean: int = 3000


LEET = {"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "!": "i", "|": "l", "€": "e", "£": "l"}
MASKS = "*○●◯〇×✕＊#"
MASK_POINTS = [ord(m) for m in MASKS]
MASK = ord("*")


@lru_cache(1)
def char_table() -> np.ndarray:
    """Code point -> folded code point; 0 for what is not seen."""
    table = np.arange(0x110000, dtype=np.uint32)
    for o, plain in fixed_map().items():
        if len(plain) <= 1:
            table[o] = ord(plain) if plain else 0
    for o in range(0x3000):
        low = chr(int(table[o])).lower()
        if len(low) == 1 and table[o]:
            table[o] = ord(low)
    full = [o for o in range(0xFF21, 0xFF3B)]
    table[full] = [o - 0xFF21 + ord("a") for o in full]
    hira = np.arange(0x3041, 0x3097)
    table[hira] = hira + 0x60
    for half, mark in ((0xFF9E, 0x3099), (0xFF9F, 0x309A)):
        table[half] = mark
    for ch in "ー":
        table[ord(ch)] = ord("ー")
    table[[0x0D, 0x09, 0x0B, 0x0C, 0x85]] = 32
    table[[0x2028, 0x2029]] = 10
    return table


LETTER, CJK, SIGN, STOP, BLANK, GAP, DIGIT, END = 1, 2, 4, 8, 16, 32, 64, 128


@lru_cache(1)
def class_table() -> tuple[np.ndarray, np.ndarray]:
    """(folded code point -> class bits, code point -> letter it stands for or 0)."""
    k = np.zeros(0x110000, dtype=np.uint8)
    k[97:123] = LETTER
    k[0xE0:0x250] = LETTER
    k[0x3041:0x3100] = CJK
    k[0x3400:0xA000] = CJK
    k[48:58] = DIGIT
    leet = np.zeros(0x110000, dtype=np.uint32)
    for a, b in LEET.items():
        leet[ord(a)] = ord(b)
        k[ord(a)] |= SIGN
    for m in MASKS:
        k[ord(m)] |= SIGN
    k[[46, 33, 63, 0x3002]] |= STOP
    k[10] = END
    k[32] = BLANK | GAP
    k[[45, 46, 95]] |= GAP
    return k, leet


def prepare(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded characters, their sentence, the document of each sentence, the place of each character in
    the texts joined by line ends) of the texts.

    Sentences end after ``.`` before a blank or a Japanese letter, after ``!?`` and the Japanese stop,
    and at line ends; a document starts a sentence.  What is rare is found once by its class and
    handled at those positions only."""
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    c = char_table()[raw]
    place = np.arange(len(c))
    gone = c == 0
    if gone.any():
        left = np.cumsum(~gone)
        ends = left[ends] - 1
        c, place = c[~gone], place[~gone]
    apart = np.flatnonzero((c == 0x3099) | (c == 0x309A))
    if len(apart):  # kana with a voicing mark written apart
        apart = apart[apart > 0]
        base = c[apart - 1]
        fits = (base >= 0x30A6) & (base <= 0x30DB)
        c[apart[fits] - 1] += c[apart[fits]] - 0x3098
        keep = np.ones(len(c), bool)
        keep[apart] = False
        ends = np.cumsum(keep)[ends] - 1
        c, place = c[keep], place[keep]
    kinds, leet = class_table()
    k = kinds[c]
    n = len(c)

    def at(i: np.ndarray, step: int) -> np.ndarray:
        j = i + step
        return np.where((j >= 0) & (j < n), k[np.clip(j, 0, n - 1)], END)

    # sentence ends
    stop = k == END
    i = np.flatnonzero(k & STOP)
    after = at(i, 1)
    latin = (at(i, -1) & LETTER > 0) & (after & LETTER > 0)
    stop[i[np.where(c[i] == 46, (after & (BLANK | CJK)) > 0, ~latin & (after & END == 0))]] = True
    # digits and signs in place of letters, from left to right; what is left of the signs is a mask
    i = np.flatnonzero(k & SIGN)
    if len(i):
        for _ in range(3):
            yes = (leet[c[i]] > 0) & (at(i, -1) & LETTER > 0) & ((at(i, 1) & LETTER > 0) | (leet[c[np.clip(i + 1, 0, n - 1)]] > 0))
            # a sign (not a digit) also stands for a letter at the start or end of a word
            yes |= ((c[i] == 36) | (c[i] == 64)) & ((at(i, -1) & LETTER > 0) | (at(i, 1) & LETTER > 0))
            if not yes.any():
                break
            c[i[yes]] = leet[c[i[yes]]]
            k[i[yes]] = LETTER
        m = i[np.isin(c[i], MASK_POINTS)]
        beside = (at(m, -1) & LETTER > 0) | (at(m, 1) & LETTER > 0) | ((at(m, -1) & CJK > 0) & (at(m, 1) & CJK > 0)) | (at(m, -1) & SIGN > 0) | (at(m, 1) & SIGN > 0)
        c[m[beside]] = MASK
    # blanks and signs inside spaced-out words, blanks between Japanese characters
    i = np.flatnonzero(k & GAP)
    single = (at(i, -1) & LETTER > 0) & (at(i, -2) & LETTER == 0) & (at(i, 1) & LETTER > 0) & (at(i, 2) & LETTER == 0)
    joined = (c[i] == 32) & (at(i, -1) & CJK > 0) & (at(i, 1) & CJK > 0)
    drop = np.zeros(n, bool)
    drop[i[single | joined]] = True
    stop[i[single]] = False
    # stretched letters: runs of three or more become one; so do runs of signs and blanks
    same = np.flatnonzero(c[1:] == c[:-1]) + 1
    if len(same):
        kind = k[same]
        twice = (c[np.clip(same + 1, 0, n - 1)] == c[same]) & (same + 1 < n) | (c[np.clip(same - 2, 0, n - 1)] == c[same]) & (same >= 2)
        drop[same[(kind & (LETTER | CJK) > 0) & twice | (c[same] == MASK) | (c[same] == 32)]] = True
        lines = same[c[same] == 10] - 1  # of several line ends the last counts
        drop[lines], stop[lines] = True, False
    drop[ends], stop[ends] = False, True
    keep = ~drop | stop
    c, place = c[keep], place[keep]
    c[(kinds[c] & DIGIT) > 0] = 48
    closing = np.flatnonzero(stop[keep])
    sizes = np.diff(np.r_[-1, closing])
    sentence = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    ends = np.cumsum(keep)[ends] - 1
    doc = np.searchsorted(ends, closing)
    return c.astype(np.uint64), sentence, doc, place


def grams(c: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each size n, the bucket of the n-gram at every character (those at ends of sentences reach
    into the next; the caller leaves them out)."""
    h = c.copy()
    for n in range(2, max(SIZES) + 1):
        last = len(c) - n + 1
        if last <= 0:
            return
        h = h[:last]
        h *= np.uint64(1_000_003)
        h += c[n - 1 :]
        if n in SIZES:
            mixed = h * np.uint64(0x9E3779B97F4A7C15)
            mixed >>= np.uint64(64 - BITS)
            yield n, mixed.view(np.int64)


def in_sentence(i: np.ndarray, n: int, sentence: np.ndarray) -> np.ndarray:
    return i[sentence[i] == sentence[i + n - 1]]


@dataclass
class Model:
    weights: np.ndarray  # 2^BITS
    bias: float

    def __post_init__(self) -> None:
        self.any = self.weights > 0

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(logit of each sentence, its document)."""
        c, sentence, doc, _ = prepare(texts)
        z = np.full(len(doc), self.bias)
        for n, g in grams(c):
            hit = in_sentence(np.flatnonzero(self.any[g]), n, sentence)  # most n-grams carry no weight
            z += np.bincount(sentence[hit], self.weights[g[hit]], len(doc))
        return z, doc


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def blocks(texts: list[str], most: int = 250_000) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts with about ``most`` characters, whatever their lengths."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < most):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def frequencies(texts: list[str], of: np.ndarray | None = None) -> np.ndarray:
    """The number of texts with each n-gram; ``of``: only of these."""
    df = np.zeros(2**BITS, np.int64)
    wanted = np.ones(2**BITS, bool) if of is None else np.zeros(2**BITS, bool)
    if of is not None:
        wanted[of] = True
    for at, end in blocks(texts):
        c, sentence, doc, _ = prepare(texts[at:end])
        who = doc.astype(np.int64) << BITS
        found = []
        for n, g in grams(c):
            i = in_sentence(np.flatnonzero(wanted[g]), n, sentence)
            found.append(who[sentence[i]] | g[i])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        df += np.bincount(pairs & (2**BITS - 1), minlength=2**BITS)
    return df


@dataclass
class Bags:
    """Labelled documents as bags of sentences: for each n-gram that stands in one, its sentence and its
    place among the candidates, and for each sentence with any its document; ``bad`` per document."""

    row: np.ndarray
    col: np.ndarray
    bag: np.ndarray
    bad: np.ndarray


def features(texts: list[str], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, sentence, candidate) of every occurrence of the candidate n-grams."""
    number = np.full(2**BITS, -1)
    number[ids] = np.arange(len(ids))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n_sent = 0
    for at, end in blocks(texts):
        c, sentence, doc, _ = prepare(texts[at:end])
        for n, g in grams(c):
            i = in_sentence(np.flatnonzero(number[g] >= 0), n, sentence)
            out.append((doc[sentence[i]] + at, sentence[i] + n_sent, number[g[i]]))
        n_sent += len(doc)
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def telling(offending: np.ndarray, n_offending: int, rest: np.ndarray, n_rest: int, ratio: float) -> np.ndarray:
    """Which n-grams are at least ``ratio`` times as frequent in offending documents as in the rest, where
    each counts as seen once more than it was."""
    return (offending > 0) & (offending / max(1, n_offending) >= ratio * (rest + 1) / max(1, n_rest))


def optimise(bags: Bags, n_ids: int, rounds: int = 150, bias: float = BIAS) -> np.ndarray:
    """Weights by projected gradient (Adam) on the noisy-or likelihood of the documents' labels.  The bound
    on a weight keeps one chance n-gram from carrying a document."""
    w = np.full(n_ids, 0.1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    pos = bags.bad[bags.bag]
    for t in range(1, rounds + 1):
        p = sigmoid(bias + np.bincount(bags.row, w[bags.col], len(bags.bag)))
        q = np.exp(np.bincount(bags.bag, np.log1p(-np.minimum(p, 1 - 1e-9)), len(bags.bad)))
        grad_z = np.where(pos, -p * (q / np.maximum(1 - q, 1e-6))[bags.bag], p)
        g = np.bincount(bags.col, grad_z[bags.row], n_ids) + 0.003 * w + 0.0005
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = np.clip(w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6), 0, 2.0)
    return np.where(w > 1e-3, w, 0)


def bags_of(doc: np.ndarray, sentence: np.ndarray, col: np.ndarray, bad: np.ndarray) -> Bags:
    """Only the sentences with candidates take part; others stay at the bias."""
    used, row = np.unique(sentence, return_inverse=True)
    bag = np.zeros(len(used), np.int64)
    bag[row] = doc
    return Bags(row, col, bag, bad)


def model_of(ids: np.ndarray, weights: np.ndarray) -> Model:
    full = np.zeros(2**BITS, dtype=np.float32)
    full[ids] = weights
    return Model(full, BIAS)


def train(offending: list[str], clean: list[str], others: list[str] = [], rounds: int = 150) -> Model:
    """The model of a few texts at hand, by the steps of ``fit``; ``others`` are unlabelled."""
    bad, rest = frequencies(offending), frequencies(clean)
    every = bad + rest + frequencies(others)
    n = len(offending), len(clean), len(offending) + len(clean) + len(others)
    ids = np.flatnonzero(telling(bad, n[0], rest, n[1], RATIO) & telling(bad, n[0], every, n[2], RATIO))
    bags = bags_of(*features([*offending, *clean], ids), np.arange(n[0] + n[1]) < n[0])
    return model_of(ids, optimise(bags, len(ids), rounds))


def gram_counts(texts: DataFrame, of: np.ndarray | None = None) -> DataFrame:
    """(text, ...) -> (gram, n): partial document frequencies, one row per partition and n-gram."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(2**BITS, np.int64)
        for b in batches:
            df += frequencies(b["text"].tolist(), of)
        ids = np.flatnonzero(df)
        yield pd.DataFrame({"gram": ids.astype("int32"), "n": df[ids]})

    return texts.select("text").mapInPandas(run, "gram int, n long")


def fit(documents: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> Model:
    """From (doc_id, text) and (doc_id, category: ``none`` or a kind of offence).  A document with both
    verdicts counts as offending.

    N-grams that tell the labelled offending documents from the labelled clean ones are candidates; of
    these, the ones that stay when their frequency over all documents is taken are learnt.  (Some
    unlabelled documents offend too, but few beside all.)"""
    verdict = labels.where("doc_id is not null and category is not null").groupBy("doc_id").agg(F.max((F.col("category") != "none").cast("int")).alias("bad"))
    order = F.xxhash64("doc_id")
    text = documents.where("doc_id is not null and length(text) > 0").select("doc_id", "text")
    # the ids are sampled first, so only the chosen texts are moved
    chosen = verdict.where("bad = 1").orderBy(order).limit(sample.offending).unionByName(verdict.where("bad = 0").orderBy(order).limit(sample.clean))
    read = cut(text.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]))
    size = {r[0]: r[1] for r in read.groupBy("bad").count().collect()}
    if not size.get(1):
        return model_of(np.zeros(0, np.int64), np.zeros(0))
    n_bad, n_clean = size[1], max(1, size.get(0, 0))
    sides = [gram_counts(read.where(F.col("bad") == k)).groupBy("gram").agg(F.sum("n").alias(f"n{k}")) for k in (1, 0)]
    both = sides[0].join(sides[1], "gram", "left").where(F.col("n1") / n_bad >= RATIO * (F.coalesce("n0", F.lit(0)) + 1) / n_clean)
    known = both.select("gram", "n1").toArrow()
    ids, bad = known["gram"].to_numpy().astype(np.int64), known["n1"].to_numpy()
    n_docs = text.count()
    every = gram_counts(text, ids).groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    rest = np.zeros(2**BITS, np.int64)
    rest[every["gram"].to_numpy()] = every["n"].to_numpy()
    ids = np.sort(ids[telling(bad, n_bad, rest[ids], n_docs, RATIO)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            doc, sentence, col = features(b["text"].tolist(), ids)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[doc], "bad": b["bad"].to_numpy()[doc], "sentence": sentence.astype("int32"), "col": col.astype("int32")})

    got = read.select("doc_id", "bad", "text").mapInPandas(run, "doc_id long, bad int, sentence int, col int").orderBy("doc_id", "sentence", "col").toPandas()
    docs, doc = np.unique(got["doc_id"].to_numpy(), return_inverse=True)
    offends = np.zeros(len(docs), bool)
    offends[doc] = got["bad"].to_numpy() == 1
    # sentences are numbered within a block of texts, so a sentence is known by its document and number
    sentence = np.unique(np.stack([doc, got["sentence"].to_numpy()]), axis=1, return_inverse=True)[1].reshape(-1) if len(got) else np.zeros(0, np.int64)
    return model_of(ids, optimise(bags_of(doc, sentence, got["col"].to_numpy(), offends), len(ids)))


def scores(documents: DataFrame, model: Model, offends: float = OFFENDS) -> DataFrame:
    """(doc_id, score, n_offending, worst): the noisy-or score, the number of offending sentences and
    the position of the likeliest one from 0 (null without text); other columns are left out."""
    ids = np.flatnonzero(model.weights)
    sent = documents.sparkSession.sparkContext.broadcast((ids, model.weights[ids], model.bias))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, values, bias = sent.value
        weights = np.zeros(2**BITS, dtype=np.float32)
        weights[where] = values
        own, floor = Model(weights, bias), float(sigmoid(np.array(bias)))
        for b in batches:
            texts = b["text"].fillna("").tolist()
            out = []
            for at, end in blocks(texts):
                z, doc = own.logits(texts[at:end])
                p = sigmoid(z)
                n = end - at
                first = np.searchsorted(doc, np.arange(n))
                # what a sentence has by the bias alone is no evidence, however many there are
                beyond = np.maximum(0, (p - floor) / (1 - floor))
                rest = np.exp(np.bincount(doc, np.log1p(-np.minimum(beyond, 1 - 1e-12)), n))
                best = np.lexsort((-p, doc))[np.searchsorted(doc, np.arange(n))]
                empty = np.array([not t for t in texts[at:end]])
                out.append(
                    pd.DataFrame(
                        {
                            "score": np.where(empty, 0.0, 1 - rest),
                            "n_offending": np.bincount(doc, p >= offends, n).astype("int32"),
                            "worst": pd.array(np.where(empty, -1, best - first), dtype="Int32"),
                        }
                    )
                )
            res = pd.concat(out) if out else pd.DataFrame({"score": [], "n_offending": [], "worst": []})
            res.insert(0, "doc_id", b["doc_id"].to_numpy())
            res["worst"] = res["worst"].where(res["worst"] >= 0)
            yield res

    rows = documents.select("doc_id", "text").mapInPandas(run, "doc_id long, score double, n_offending int, worst int")
    return rows.where("doc_id is not null")


def sentences(documents: DataFrame, model: Model, offends: float = OFFENDS) -> DataFrame:
    """(doc_id, sentence, start, text, score) of every offending sentence: its position in the document,
    the characters before it (both from 0) and its text as written, without blanks around it."""
    ids = np.flatnonzero(model.weights)
    sent = documents.sparkSession.sparkContext.broadcast((ids, model.weights[ids]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = model_of(*sent.value)
        for b in batches:
            rows = []
            texts = b["text"].tolist()
            for at, end in blocks(texts):
                part = texts[at:end]
                z, doc = own.logits(part)
                bad = np.flatnonzero(sigmoid(z) >= offends)
                if not len(bad):
                    continue
                _, sentence, _, place = prepare(part)
                begins = np.cumsum([0, *[len(t) + 1 for t in part]])
                first = place[np.searchsorted(sentence, np.arange(len(doc) + 1)).clip(max=len(place) - 1)]
                for s in bad:
                    k = doc[s]
                    start = int(max(first[s], begins[k]) - begins[k])
                    stop = int(first[s + 1] - begins[k]) if s + 1 < len(doc) and doc[s + 1] == k else len(part[k])
                    written = part[k][start:stop]
                    start += len(written) - len(written.lstrip())
                    rows.append((b["doc_id"].iloc[at + k], int(s - np.searchsorted(doc, k)), start, written.strip(), float(sigmoid(z[s]))))
            yield pd.DataFrame(rows, columns=["doc_id", "sentence", "start", "text", "score"])

    return documents.where("doc_id is not null and length(text) > 0").select("doc_id", "text").mapInPandas(run, "doc_id long, sentence int, start int, text string, score double")


def rates(documents: DataFrame, scored: DataFrame) -> DataFrame:
    """(source, n_docs, n_offending, rate) per source; documents without one under ''."""
    return (
        documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
        .distinct()
        .join(scored.select("doc_id", "n_offending").distinct(), "doc_id")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("n_offending") > 0).alias("n_offending"))
        .withColumn("rate", F.col("n_offending") / F.col("n_docs"))
    )
