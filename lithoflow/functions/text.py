"""Column functions on text that Spark's own functions express; none of them needs Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column | str) -> Column:
    """Without white space of any script around it (``trim`` knows the plain blank only)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def nonblank(c: Column | str) -> Column:
    """True where the text holds something besides white space; false for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def first_of(*cols: Column) -> Column:
    """The first value that is neither null nor blank, without white space around it; else ''."""
    return F.coalesce(*[F.when(nonblank(c), strip(c)) for c in cols], F.lit(""))


def join_distinct(*cols: Column, sep: str = " / ") -> Column:
    """The distinct non-blank values in the order they first appear."""
    kept = F.filter(F.array(*[F.when(nonblank(c), strip(c)) for c in cols]), lambda x: x.isNotNull())
    return F.array_join(F.array_distinct(kept), sep)


def readable(code: Column) -> Column:
    return F.trim(F.translate(code, "_", " "))


#: What counts as a readable character besides letters, digits and white space.
READABLE = r"[\p{L}\p{N}\s\p{Z}\x{1c}-\x{1f}\x{85}\x{3000}-\x{9FFF}\x{F900}-\x{FAFF}、。・，．（）「」]"


def text_quality(c: Column) -> Column:
    """The share of readable characters; 0 for an empty text, null for null."""
    n = F.length(c)
    return F.when(n > 0, F.regexp_count(c, F.lit(READABLE)) / n).when(n == 0, F.lit(0.0))
