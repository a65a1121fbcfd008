"""Priority rules: the first rule that matches, for each fact.

Facts are reduced to distinct values first.  Keywords of a small rule table are searched as a constant
within each row, so matching is one projection; those of a table of any size are found by an automaton in
Arrow batches and joined to their rules by equality.  Both give the same rows.  Rules with a wildcard are
two equi-joins.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoflow.functions.text import nonblank

BROADCAST_RULES = 100_000
#: Up to so many keywords are searched as a constant within each row.
CONSTANT_KEYWORDS = 5_000
#: Age markers of ground older than the Holocene.
OLD_AGES = ("更新世", "鮮新世", "中新世", "Pleistocene", "Pliocene", "Miocene")
#: Confidence from worst to best.
SEVERITY = ("very_low", "low", "medium", "high")


def small(rules: DataFrame) -> DataFrame:
    """The rules, marked for broadcast after counting them; larger ones are left to the planner."""
    return F.broadcast(rules) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else rules


def constant(rules: DataFrame, most: int = CONSTANT_KEYWORDS) -> Column | None:
    """The rows of a small table as one constant array of structs, to be searched within each row of
    another table: neither a join nor a shuffle.  None for a larger table."""
    rows = rules.limit(most + 1).collect()
    if len(rows) > most:
        return None
    return F.from_json(F.lit(json.dumps([r.asDict() for r in rows], ensure_ascii=False)), T.ArrayType(rules.schema))


def keywords_in(text: Column, keywords: DataFrame) -> Column:
    """The distinct keywords (kw) that a text contains, found by one automaton over all of them."""
    words = sorted(r[0] for r in keywords.select("kw").where("kw <> ''").distinct().toLocalIterator())
    sent = keywords.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("array<string>")
    def search(texts: pd.Series) -> pd.Series:
        import ahocorasick

        auto = ahocorasick.Automaton()
        for w in sent.value:
            auto.add_word(w, w)
        if not sent.value:
            return pd.Series([[] for _ in texts])
        auto.make_automaton()
        return pd.Series([sorted({w for _, w in auto.iter(t)}) if t else [] for t in texts])

    return search(text)


def held(df: DataFrame, value: Column) -> DataFrame:
    """df with ``_m``, computed once per row.  A generator, as filters on columns made from ``_m`` would
    otherwise be pushed below it, each with its own copy of the search."""
    return df.select("*", F.explode(F.array(value)).alias("_m"))


def keyword_rules(terms: DataFrame, order: str = "term_id") -> DataFrame:
    """One row per keyword: (term_id, match_on, kw, kw_no, priority, row_no, material, grain); keywords are
    separated by ``;``, blank ones are left out.  ``row_no`` stands for the file order: it comes from
    ``order``."""
    rows = terms.where(F.col("term_id").isNotNull() & ~F.col("term_id").startswith("#"))
    kws = F.filter(F.transform(F.split("match_keywords_ja", ";"), lambda k: F.trim(k)), lambda k: k != "")
    return rows.select("term_id", "match_on", "priority", F.col(order).alias("row_no"), F.col("geological_material").alias("material"), F.col("grain_or_rock").alias("grain"), F.posexplode(kws).alias("kw_no", "kw"))


def match_terms(units: DataFrame, rules: DataFrame) -> DataFrame:
    """units with (name, litho) -> with term_id, keyword, field, l1_confidence, material and grain of the
    first match.

    A rule looks in its own field (pass 1); only units without any such match take a keyword found
    anywhere in name and lithology (pass 2).  Both passes are one: the pass leads the order."""
    fields = ("priority", "row_no", "kw_no", "term_id", "kw", "match_on", "material", "grain")
    table = constant(rules.select(*fields))
    hay = F.concat("name", F.lit(" "), "litho")

    def ranked(r: Column | None) -> Column:
        of = lambda k: F.col(k) if r is None else r[k]
        own = F.when(of("match_on") == "name", F.col("name")).otherwise(F.col("litho"))
        return F.struct(F.when(F.contains(own, of("kw")), 1).otherwise(2).alias("pass"), *[of(k).alias(k) for k in fields])

    if table is not None:
        found = held(units, F.array_min(F.transform(F.filter(table, lambda r: F.contains(hay, r["kw"])), ranked)))
    else:
        hits = units.select("name", "litho").distinct().withColumn("kw", F.explode(keywords_in(hay, rules))).join(rules.select(*fields), "kw")
        best = hits.groupBy(F.col("name").alias("_name"), F.col("litho").alias("_litho")).agg(F.min(ranked(None)).alias("_m"))
        found = units.join(best, (F.col("name") == F.col("_name")) & (F.col("litho") == F.col("_litho")), "left")
    m = F.col("_m")
    field = F.when(m["pass"] == 2, "name+litho").otherwise(m["match_on"])
    conf = F.when(m["pass"].isNull(), "very_low").when(m["pass"] == 2, "low").when(m["match_on"] == "name", "high").otherwise("medium")
    return found.select(*units.columns, m["term_id"].alias("term_id"), m["kw"].alias("keyword"), field.alias("field"), conf.alias("l1_confidence"), m["material"].alias("material"), m["grain"].alias("grain"))


def is_old(age: Column) -> Column:
    return F.coalesce(age.rlike("|".join(OLD_AGES)), F.lit(False))


#: What a translation gives besides its row's id, family and ground type, where the table has it.
L2_MORE = ("geotech_term_ja", "geotech_term_en", "geotech_synonyms_ja", "rationale_en", "source_ref")


def translate(facts: DataFrame, rules: DataFrame, order: str = "map_id", more: Sequence[str] = ()) -> DataFrame:
    """facts with (material, grain) -> with map_id, family, ground_type, l2_confidence and ``more``: the first
    rule by priority, then ``order``, whose material fits and whose grain fits or is ``*``."""
    extra = [(F.col(c) if c in rules.columns else F.lit(None).cast("string")).alias(c) for c in more]
    rows = rules.where("map_id is not null").select(F.col("match_geological_material").alias("_material"), F.col("match_grain_or_rock").alias("_grain"), F.struct("priority", F.col(order).alias("order"), "map_id", F.col("match_grain_or_rock").alias("g"), F.col("engineering_material_family").alias("family"), F.col("engineering_ground_type").alias("ground"), *extra).alias("r"))
    first = rows.groupBy("_material", "_grain").agg(F.min("r").alias("r"))
    exact = first.where("_grain <> '*'").withColumnRenamed("r", "_exact")
    any_grain = first.where("_grain = '*'").select(F.col("_material").alias("_star"), F.col("r").alias("_any"))
    out = facts.join(exact, (F.col("material") == F.col("_material")) & (F.col("grain") == F.col("_grain")), "left").join(any_grain, F.col("material") == F.col("_star"), "left").withColumn("_m", F.least("_exact", "_any"))
    m = F.col("_m")
    conf = F.when(m["map_id"].isNull(), "very_low").when(m["g"] == "*", "medium").otherwise("high")
    return out.select(*facts.columns, m["map_id"].alias("map_id"), m["family"].alias("family"), F.coalesce(m["ground"], F.lit("mixed_or_uncertain_geology")).alias("ground_type"), conf.alias("l2_confidence"), *[m[c].alias(c) for c in more])


def match_rules(units: DataFrame, rules: DataFrame, name: str = "raw_unit_name_ja") -> DataFrame:
    """units with rule_id, keyword, family, ground type, flags, confidence and reason of the first keyword rule
    (see ``knowledge.rules_table``), by ascending priority, then file order.  A rule matches where any of
    its keywords stands in any of its fields, whatever the case; columns that the first rule leaves
    empty are filled from the next ones.  Fields that units lack are never matched; a unit without a match
    has nulls and no flags.  In the reason, ``{name}`` and ``{kw}`` are filled in."""
    filled = ("engineering_material_family", "engineering_ground_type", "confidence", "reason")
    fields = [c for c in units.columns if c not in ("_unit",)]
    rows = units.select(F.xxhash64(F.to_json(F.struct(*units.columns))).alias("_id"), F.struct(*units.columns).alias("_unit")).distinct()
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.lower(F.col(f"_unit.{c}").cast("string")).alias("text")) for c in fields])
    by_kw = rules.select("rule_id", "priority", "row_no", F.explode("fields").alias("field"), F.posexplode("keywords").alias("kw_no", "kw"), "risk_flags", *filled).withColumn("kw", F.lower("kw"))
    texts = rows.select("_id", "_unit", F.inline(pairs)).where("text <> ''")
    hits = texts.withColumn("kw", F.explode(keywords_in(F.col("text"), by_kw))).join(by_kw, ["field", "kw"])
    key = F.struct("priority", "row_no", "kw_no")
    found = hits.groupBy("_id", "_unit").agg(F.min_by(F.struct("rule_id", "kw", "risk_flags"), key).alias("_f"), *[F.min_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"_{c}") for c in filled])
    joined = rows.join(found.drop("_unit"), "_id", "left")
    reason = F.replace(F.replace(F.col("_reason"), F.lit("{name}"), F.coalesce(F.col(f"_unit.{name}"), F.lit(""))), F.lit("{kw}"), F.coalesce(F.col("_f.kw"), F.lit("")))
    return joined.select("_unit.*", F.col("_f.rule_id").alias("rule_id"), F.col("_f.kw").alias("keyword"), *[F.col(f"_{c}").alias(c) for c in filled[:3]], reason.alias("reason"), F.coalesce("_f.risk_flags", F.array().cast("array<string>")).alias("risk_flags"))


def severity(level: Column) -> Column:
    """0 for the worst level; null for a level that isn't one."""
    out = F.lit(None).cast("int")
    for k, name in enumerate(SEVERITY):
        out = F.when(level == name, k).otherwise(out)
    return out


def worst(*levels: Column) -> Column:
    """The worst of the valid levels; ``very_low`` if none is."""
    k = F.coalesce(F.least(*[severity(x) for x in levels]) if len(levels) > 1 else severity(levels[0]), F.lit(0))
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), k + 1)


def needs_review(overall: Column, ground_type: Column, name: Column) -> Column:
    return overall.isin("low", "very_low") | (ground_type == "mixed_or_uncertain_geology") | ~nonblank(name)
