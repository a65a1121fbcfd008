"""The four-layer chain from a unit's name, lithology and age to ground type, confidence and flags.

Units are reduced to distinct (name, litho, age) first; the layers look their rules up for that set, which
goes back to the features by one join.  Each step of the chain has its inputs, outputs, evidence, sources
and confidence.

Defined results: null names, lithologies and ages count as ''; units without any match get ground type
``mixed_or_uncertain_geology`` with confidence ``very_low`` and are to be reviewed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoflow.operators import rules as R
from lithoflow.session import cut

#: The terms that an old age turns into other ground.
OLD_COARSE, OLD_FINE = ("L1_litho_gravel", "L1_litho_sand"), ("L1_litho_mud_silt",)


def units(features: DataFrame) -> DataFrame:
    """The distinct (name, litho, age)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return features.select(text("raw_unit_name_ja").alias("name"), text("raw_lithology").alias("litho"), text("raw_age").alias("age")).distinct()


#: What a term says of the geology, besides its material and grain.
L1_MORE = ("primary_lithology_ja", "primary_lithology_en", "depositional_environment_ja", "depositional_environment_en", "typical_consolidation", "formation_group_ja", "stratigraphic_note_en", "source_ref")
#: Titles and evidence of the steps, and the consolidation of older ground.
TITLES = {
    "L1_geology": ("Geology identification", "地質の同定"),
    "L2_geotech_translation": ("Geotechnical translation", "地盤工学への翻訳"),
    "L3_indicative_properties": ("Indicative properties (screening, non-design)", "想定物性（スクリーニング・非設計値）"),
    "L4_considerations": ("Geotechnical considerations & investigation", "地盤工学的留意点と推奨調査"),
}
OLD_CONSOLIDATION = "overconsolidated (pre-Holocene)"
MATCHED = "Matched '%s' in %s -> %s (%s, %s)."
NO_TERM, NO_MAP = "No L1 geology term matched the unit name or lithology.", "No L2 mapping matched; defaulted to uncertain geology."
OLD_COARSE_TEXT = "Age refinement: '%s' is pre-Holocene -> treated as overconsolidated (diluvial) granular ground rather than soft Holocene alluvium."
OLD_FINE_TEXT = "Age refinement: '%s' is pre-Holocene -> fine soil likely overconsolidated/stiff rather than soft normally-consolidated clay."
L3_TEXT = "Indicative screening bands; NOT design values (design_use: false)."
L4_TEXT = "Conditional screening considerations ('may be relevant -> investigate'); not design conclusions."
SOURCE = "array<struct<id:string,title:string,url:string,tier:string>>"


def with_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df with the columns it lacks as null texts."""
    return df.withColumns({c: F.lit(None).cast("string") for c in names if c not in df.columns})


def term_properties(terms: DataFrame, order: str) -> DataFrame:
    """(term_id, *L1_MORE) of the first row of each term."""
    rows = with_columns(terms, L1_MORE).where("term_id is not null")
    return rows.groupBy("term_id").agg(F.min_by(F.struct(*L1_MORE), order).alias("p")).select("term_id", "p.*")


def identify(units: DataFrame, terms: DataFrame, order: str = "term_id", coarse_terms: Column | None = None, fine_terms: Column | None = None) -> DataFrame:
    """Layer 1: the term, its material and grain and what else it says, refined by age.  ``coarse_terms``,
    ``fine_terms``: which terms (over term_id, material, grain) an old age refines."""
    coarse_terms = F.col("term_id").isin(*OLD_COARSE) if coarse_terms is None else coarse_terms
    fine_terms = F.col("term_id").isin(*OLD_FINE) if fine_terms is None else fine_terms
    out = R.match_terms(units, R.keyword_rules(terms, order))
    old = R.is_old(F.col("age"))
    coarse, fine = F.coalesce(old & coarse_terms, F.lit(False)), F.coalesce(old & fine_terms, F.lit(False))
    out = out.withColumns({"_coarse": coarse, "age_refined": coarse | fine})
    out = out.join(term_properties(terms, order), "term_id", "left")
    c = F.col
    said = lambda x: F.coalesce(x, F.lit("None"))
    line = F.when(c("term_id").isNull(), F.lit(NO_TERM)).otherwise(F.format_string(MATCHED, "keyword", "field", "term_id", said(c("primary_lithology_en")), said(c("typical_consolidation"))))
    refined = F.when(c("_coarse"), F.array(F.format_string(OLD_COARSE_TEXT, "age"))).when(c("age_refined"), F.array(F.format_string(OLD_FINE_TEXT, "age"))).otherwise(F.array().cast("array<string>"))
    return out.select(
        "name", "litho", "age", "term_id", "keyword", "field",
        F.coalesce("material", F.lit("unknown")).alias("material"),
        F.when(c("_coarse"), "terrace_gravel").otherwise(c("grain")).alias("grain"),
        "age_refined",
        F.when(c("_coarse"), "medium").otherwise(c("l1_confidence")).alias("l1_confidence"),
        *[x for x in L1_MORE if x not in ("typical_consolidation", "source_ref")],
        F.when(c("age_refined"), OLD_CONSOLIDATION).otherwise(c("typical_consolidation")).alias("consolidation"),
        c("source_ref").alias("l1_source_ref"),
        F.concat(F.array(line), refined).alias("l1_evidence"),
    )


#: The columns of a unit's flat result.
FLAT = ("name", "litho", "age", "term_id", "keyword", "field", "material", "grain", "age_refined", "map_id", "family", "ground_type", "l1_confidence", "l2_confidence", "overall_confidence", "needs_manual_review")


def infer(features: DataFrame, terms: DataFrame, l2: DataFrame, risk: DataFrame | None = None, term_order: str = "term_id", coarse_terms: Column | None = None, fine_terms: Column | None = None, map_order: str = "map_id") -> DataFrame:
    """Per distinct unit: all layers' results, overall confidence, review flag and risk flags (of the ground
    type; none for a type without)."""
    found = identify(units(features), terms, term_order, coarse_terms, fine_terms)
    out = R.translate(found, l2, map_order, R.L2_MORE).withColumnRenamed("source_ref", "l2_source_ref")
    overall = R.worst(F.col("l1_confidence"), F.col("l2_confidence"))
    out = out.withColumn("overall_confidence", overall).withColumn("needs_manual_review", R.needs_review(F.col("overall_confidence"), F.col("ground_type"), F.col("name")))
    if risk is not None:
        out = out.join(R.small(risk), "ground_type", "left").withColumn("risk_flags", F.coalesce("flags", F.array().cast("array<string>"))).drop("flags")
    return out


def resolved(refs: DataFrame, registry: DataFrame | None) -> DataFrame:
    """(ref) of ``;``-separated source ids -> (ref, sources): the registry's entries in their order."""
    ids = refs.select("ref").where("ref <> ''").distinct()
    reg = ids.sparkSession.createDataFrame([], "source_id string, title string, url string, tier string") if registry is None else with_columns(registry, ("url",))
    rows = source_refs(ids.withColumn("r", F.col("ref")), "ref", "r", reg)
    return rows.groupBy("ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source_id", "title", "url", "tier"))), lambda x: F.struct(x["source_id"].alias("id"), x["title"].alias("title"), x["url"].alias("url"), x["tier"].alias("tier"))).alias("sources"))


def step(name: str, ref: Column, inputs: Column, outputs: Column, evidence: Column, sources: Column, confidence: Column, keyword: Column | None = None, field: Column | None = None) -> Column:
    """One step of a chain.  Inputs and outputs are maps of texts (nested ones as JSON), so that all steps
    have one type."""
    none = F.lit(None).cast("string")
    text = lambda c: c.cast("map<string,string>")
    en, ja = TITLES[name]
    return F.struct(
        F.lit(name).alias("step"), F.lit(en).alias("title_en"), F.lit(ja).alias("title_ja"), text(inputs).alias("inputs"), ref.alias("knowledge_ref"), (none if keyword is None else keyword).alias("matched_keyword"), (none if field is None else field).alias("matched_field"),
        text(outputs).alias("outputs"), evidence.cast("array<string>").alias("evidence"), F.coalesce(sources, F.array()).cast(SOURCE).alias("sources"), confidence.alias("confidence"),
    )


def with_chain(inferred: DataFrame, properties: DataFrame | None = None, advice: DataFrame | None = None, sources: DataFrame | None = None, names: Mapping[str, str] | None = None) -> DataFrame:
    """Adds ``chain``: the ordered steps.  properties, advice: tables by ground type (see ``knowledge``); a
    type without properties has an empty step with confidence ``very_low``, one without advice has
    empty outputs.  sources: the registry that references are looked up in.  names: what L1 to L4 are
    called in references."""
    names = {"l1": "L1", "l2": "L2", "l3": "L3", "l4": "L4"} | dict(names or {})
    c = F.col
    out = inferred
    spark = out.sparkSession
    from lithoflow.knowledge import ADVICE, PROPERTIES

    for df, schema, name in ((properties, PROPERTIES, "_l3"), (advice, ADVICE, "_l4")):
        own = spark.createDataFrame([], schema) if df is None else df
        own = own.groupBy("ground_type").agg(F.first(F.struct(*[x for x in own.columns if x != "ground_type"])).alias(name))
        out = out.join(R.small(own), "ground_type", "left")
    refs = {"l1_source_ref": c("l1_source_ref"), "l2_source_ref": c("l2_source_ref"), "l3_source_ref": c("_l3.source_ref")}
    out = out.withColumns({k: v for k, v in refs.items() if k not in out.columns})
    out = cut(out)  # it is read for its references, too
    known = resolved(out.select(F.explode(F.array(*refs)).alias("ref")), sources)
    for k in refs:
        out = out.join(known.select(c("ref").alias(k), c("sources").alias(f"_{k}")), k, "left")
    pairs = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), v)])
    none = F.create_map().cast("map<string,string>")
    ref = lambda name, key: F.concat(F.lit(f"{names[name]} :: "), key)
    l1_out = F.when(c("term_id").isNull(), pairs(geological_material=c("material"))).otherwise(
        pairs(geological_material=c("material"), primary_lithology_ja=c("primary_lithology_ja"), primary_lithology_en=c("primary_lithology_en"), grain_or_rock=c("grain"), depositional_environment_ja=c("depositional_environment_ja"), depositional_environment_en=c("depositional_environment_en"), typical_consolidation=c("consolidation"), formation_group_ja=c("formation_group_ja"), stratigraphic_note_en=c("stratigraphic_note_en"), age_refined=F.when(c("age_refined"), "true"))
    )
    l2_out = F.when(c("map_id").isNull(), pairs(engineering_ground_type=c("ground_type"), engineering_material_family=F.lit("mixed_or_unknown"))).otherwise(
        pairs(engineering_material_family=c("family"), engineering_ground_type=c("ground_type"), geotech_term_ja=c("geotech_term_ja"), geotech_term_en=c("geotech_term_en"), geotech_synonyms_ja=c("geotech_synonyms_ja"))
    )
    has3 = c("_l3").isNotNull()
    l3_out = pairs(summary_en=c("_l3.summary_en"), mechanical=F.to_json("_l3.mechanical"), chemical=F.to_json("_l3.chemical"), key_concerns_en=F.to_json("_l3.key_concerns_en"), design_use=c("_l3.design_use").cast("string"))
    l4_out = pairs(applications=F.coalesce(F.to_json("_l4.applications"), F.lit("{}")), recommended_investigation=F.coalesce(F.to_json("_l4.recommended_investigation"), F.lit("[]")), residual_uncertainty=F.coalesce(c("_l4.residual_uncertainty"), F.lit("")))
    ground = pairs(engineering_ground_type=c("ground_type"))
    given = lambda x: F.map_filter(x, lambda k, v: (k != "age_refined") | v.isNotNull())
    chain = F.array(
        step("L1_geology", ref("l1", c("term_id")), pairs(raw_unit_name_ja=c("name"), raw_lithology=c("litho"), raw_age=c("age")), given(l1_out), c("l1_evidence"), c("_l1_source_ref"), c("l1_confidence"), c("keyword"), c("field")),
        step("L2_geotech_translation", ref("l2", c("map_id")), pairs(geological_material=c("material"), grain_or_rock=F.coalesce("grain", F.lit("")), consolidation=F.coalesce("consolidation", F.lit(""))), l2_out, F.array(F.when(c("map_id").isNull(), F.lit(NO_MAP)).otherwise(c("rationale_en"))), c("_l2_source_ref"), c("l2_confidence")),
        step("L3_indicative_properties", F.when(has3, ref("l3", c("ground_type"))), ground, F.when(has3, l3_out).otherwise(none), F.when(has3, F.array(F.lit(L3_TEXT))).otherwise(F.array().cast("array<string>")), c("_l3_source_ref"), F.when(has3, "medium").otherwise("very_low")),
        step("L4_considerations", ref("l4", c("ground_type")), ground, l4_out, F.array(F.lit(L4_TEXT)), F.lit(None).cast(SOURCE), F.lit("medium")),
    )
    return out.withColumn("chain", chain).select(*inferred.columns, "chain")


#: The steps from last to first, as they are shown.
DISPLAY = ("L4_considerations", "L3_indicative_properties", "L2_geotech_translation", "L1_geology")


def display_order(chain: Column) -> Column:
    """The steps for display, last layer first; unknown steps at the end."""
    rank = lambda s: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in DISPLAY]), s["step"]), F.lit(0)), F.lit(9))
    return F.array_sort(chain, lambda a, b: rank(a).cast("int") - rank(b).cast("int"))


def chain_text(chain: Column) -> Column:
    return F.array_join(F.transform(chain, lambda s: F.coalesce(s["knowledge_ref"], s["step"])), " -> ")


def source_refs(rows: DataFrame, key: str, refs: str, registry: DataFrame) -> DataFrame:
    """(key, pos, source_id, title, url, tier): the ``;``-separated references in order; an unknown one has
    its id for a title and tier ``unknown``."""
    items = rows.select(key, F.posexplode(F.filter(F.transform(F.split(refs, ";"), lambda x: F.trim(x)), lambda x: x != "")).alias("pos", "source_id"))
    own = with_columns(registry, ("url",)).where("source_id is not null").groupBy("source_id").agg(F.min(F.struct("title", "url", "tier")).alias("s"))
    reg = R.small(own.select("source_id", "s.*"))
    return items.join(reg, "source_id", "left").select(key, "pos", "source_id", F.coalesce("title", "source_id").alias("title"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("tier", F.lit("unknown")).alias("tier"))
