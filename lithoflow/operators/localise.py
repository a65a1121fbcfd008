"""Codes to labels of a language, with fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoflow.functions.text import readable
from lithoflow.operators.rules import small


def localise(rows: DataFrame, code: str, labels: DataFrame, lang: str, out: str = "label") -> DataFrame:
    """labels: (code, lang, label).  The label in the language, else the English one, else the code with
    blanks for underscores; '' for a null or blank code."""
    best = labels.where(F.col("lang").isin(lang, "en")).groupBy(F.col("code").alias("_code")).agg(F.max_by("label", (F.col("lang") == lang).cast("int")).alias("_label"))
    hit = rows.join(small(best), F.col(code) == F.col("_code"), "left")
    return hit.withColumn(out, F.coalesce("_label", readable(F.col(code)), F.lit(""))).drop("_code", "_label")


def localise_lists(rows: DataFrame, key: str, codes: str, labels: DataFrame, lang: str, out: str = "labels") -> DataFrame:
    """rows with the labels of a list of codes, in its order; an empty or null list has none."""
    each = rows.select(key, F.posexplode(codes).alias("_pos", "_each"))
    named = localise(each, "_each", labels, lang, "_label_of")
    lists = named.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_label_of"))), lambda x: x["_label_of"]).alias(out))
    return rows.join(lists, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def code_lists(labels: DataFrame) -> DataFrame:
    """All codes that have a label, each once, in order."""
    return labels.where("code is not null").select("code").distinct().orderBy("code")


def at_path(paths: DataFrame, path: str, lang: str) -> str:
    """The text at a dotted path of a flattened document (path, text): in the language, else in English, else
    the path itself."""
    found = {r[0]: r[1] for r in paths.where(F.col("path").isin(path, f"{path}.{lang}", f"{path}.en")).select("path", "text").collect()}
    return next((found[p].strip() for p in (path, f"{path}.{lang}", f"{path}.en") if found.get(p)), path)
