"""Sizes of texts in tokens of a public byte-level tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies unless a path is given.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-level tokenizers of this family cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text is encoded in parts of about this many characters, cut at line ends, where no token crosses.
PART = 200_000


@lru_cache(4)
def encoding(vocabulary: bytes):  # noqa: ANN201
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def read(path: str = RANKS) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def count(text: str, vocabulary: bytes | None = None) -> int:
    enc = encoding(read() if vocabulary is None else vocabulary)
    if len(text) <= PART:
        return len(enc.encode_ordinary(text))
    n, at = 0, 0
    while at < len(text):
        end = at + PART
        # a part ends before a newline that follows a letter: the pattern never joins these
        while end < len(text) and not (text[end] == "\n" and text[end - 1].isalnum()):
            end += 1
        n += len(enc.encode_ordinary(text[at:end]))
        at = end
    return n


def counted(documents: DataFrame, path: str | None = None) -> DataFrame:
    """documents with (doc_id, text, ...) -> (doc_id, source, n_tokens), a row per doc_id; null and
    empty texts have 0 tokens.  Where an id has several texts the longest counts.  The vocabulary is read by the
    driver, from the path given or named in ``spark.lithoflow.tokenizer``, and sent to the workers."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(read(path or spark.conf.get("spark.lithoflow.tokenizer", RANKS)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = sent.value
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": [count(t, vocabulary) if t else 0 for t in b["text"]]}).astype({"n_tokens": "int64"})

    rows = documents.where("doc_id is not null").select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, n_tokens long")
    return rows.groupBy("doc_id").agg(F.max_by("source", "n_tokens").alias("source"), F.max("n_tokens").alias("n_tokens"))
