"""Several values packed in one field: one row per value, with its position.

Quoted and bracketed spans are replaced by indexed placeholders, the rest is split at the delimiters,
and the spans come back by looking their index up in the array of spans.  All of it is column
functions in one projection; nothing is shuffled before the rows are made distinct.

Defined results: null and blank fields, empty values and values of invisible characters only give no
row; positions count from 1 over the values that remain; an opening quote or bracket without its
close is plain text; a garbled field is one value; texts of any length are split whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoflow.functions.damage import looks_garbled

#: Characters that are not seen; they may stand inside a conjunction.
INVISIBLE = r"\x{A0}\x{AD}\x{180E}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}"
_I = f"[{INVISIBLE}]*"
#: How deep brackets of one kind may stand in each other.
DEPTH = 8


def nested(opening: str, closing: str, depth: int = DEPTH) -> str:
    """A pattern of a bracketed span with brackets inside.  The quantifiers give nothing back, so long spans
    take no stack."""
    plain = f"[^{opening}{closing}]"
    out = f"{opening}{plain}*+{closing}"
    for _ in range(depth - 1):
        out = f"{opening}(?:{plain}++|{out})*+{closing}"
    return out


#: Spans that are not split.
SPANS = "|".join(
    [r'"[^"]*"', "＂[^＂]*＂", "“[^”]*”", "「[^」]*」", "『[^』]*』", "【[^】]*】", "〔[^〕]*〕", "｢[^｣]*｣"]
    + [nested(r"\(", r"\)"), nested("（", "）"), nested(r"\[", r"\]"), nested("［", "］"), r"(?<![A-Za-z])'[^']*'(?![A-Za-z])"]
)
#: Single delimiters, and the conjunctions that mean "and".
DELIMITERS = r"、,，､﹐;；﹔/／∕|｜・･‧∙\t\n\r\x{0B}\x{0C}\x{85}\x{2028}\x{2029}+＋&＆"
CONJUNCTIONS = [_I.join(w) for w in ("及び", "および", "並びに", "ならびに")] + [r"(?<=\s)(?i:and)(?=\s)"]
SPLIT = "[" + DELIMITERS + "]|" + "|".join(CONJUNCTIONS)
#: What opens a span; a text without it needs no placeholders.
OPENING = r"""["'＂“「『【〔｢(（\[［]"""
#: Something to be seen.
SEEN = rf"(?U)[^\s{INVISIBLE}]"
#: Noncharacters that a placeholder's mark is made of: the second, more of the first than stand together
#: anywhere in the text, the second.  So no text can hold its own mark.
INNER, OUTER = chr(0xFDD0), chr(0xFDD1)


#: White space and invisible characters around a value.
AROUND = rf"(?U)^[\s{INVISIBLE}]+|[\s{INVISIBLE}]+$"


def split_values(c: Column, garbled: Column | None = None, trim: str = AROUND) -> Column:
    """The values of a packed text, in order, without what ``trim`` matches around them; null for null.
    ``garbled``: where true, the text is one value (by default, where it looks garbled)."""
    garbled = looks_garbled(c) if garbled is None else garbled
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit(f"({INNER}+)"), F.lit(1)), F.length)), F.lit(0))
    mark = F.concat(F.lit(OUTER), F.repeat(F.lit(INNER), F.when(F.contains(c, F.lit(INNER)), longest).otherwise(0) + 1), F.lit(OUTER))

    def pieces(b: Column) -> Column:
        mark, spans, gaps = b["mark"], b["spans"], b["gaps"]
        # gap 0, mark 0 mark, gap 1, mark 1 mark ... : as many placeholders as there are spans
        held = F.concat(F.concat_ws("", F.transform(F.slice(gaps, 1, F.size(spans)), lambda g, k: F.concat(g, mark, k.cast("string"), mark))), F.coalesce(F.try_element_at(gaps, F.lit(-1)), F.lit("")))

        def restore(p: Column) -> Column:
            ids = F.filter(F.split(p, mark, -1), lambda x, k: k % 2 == 1)
            return F.aggregate(ids, p, lambda text, k: F.replace(text, F.concat(mark, k, mark), F.coalesce(F.get(spans, k.cast("int")), F.lit(""))))

        return F.transform(F.split(held, SPLIT, -1), lambda p: F.when(F.contains(p, mark), restore(p)).otherwise(p))

    quoted = once(F.struct(mark.alias("mark"), F.regexp_extract_all(c, F.lit(f"({SPANS})"), F.lit(1)).alias("spans"), F.split(c, SPANS, -1).alias("gaps")), pieces)
    parts = F.when(c.rlike(OPENING), quoted).otherwise(F.split(c, SPLIT, -1))
    items = F.when(c.isNull(), F.lit(None)).when(garbled | ~c.rlike(SPLIT), F.array(c)).otherwise(parts)
    return F.transform(F.filter(items, lambda p: p.rlike(SEEN)), lambda p: F.regexp_replace(p, trim, ""))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once per row however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def explode_values(fields: DataFrame, garbled: Column | None = None) -> DataFrame:
    """(record_id, field_name, value) -> (record_id, field_name, pos, item, n_values), each once."""
    rows = fields.where(F.col("value").isNotNull() & F.col("record_id").isNotNull()).select("record_id", "field_name", split_values(F.col("value"), garbled).alias("items"))
    rows = rows.select("record_id", "field_name", F.size("items").alias("n_values"), F.posexplode("items").alias("p", "item"))
    return rows.select("record_id", "field_name", (F.col("p") + 1).cast("int").alias("pos"), "item", "n_values").distinct()


def found(fields: DataFrame) -> DataFrame:
    """(record_id, field_name, pos): one row per value of the fields that hold two or more."""
    rows = fields.where(F.col("value").rlike(SPLIT) & F.col("record_id").isNotNull()).select("record_id", "field_name", split_values(F.col("value")).alias("items")).where(F.size("items") > 1)
    return rows.select("record_id", "field_name", F.explode(F.sequence(F.lit(1), F.size("items"))).alias("pos")).distinct()
