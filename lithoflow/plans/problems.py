"""The queries of the general problems (1, 3, 5, 6) over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoflow.operators import nested, orphans, packed, proximity
from lithoflow.session import table

CARDS = orphans.Parent("inference_chains", "geology_unit_card_id", "built_at", "deleted_at")
SOURCES = orphans.Parent("knowledge_sources", "source_id", "registered_on", "deleted_at")
ASSETS = orphans.Parent("pdf_asset_index", "asset_id", "extracted_at", "deleted_at")
TERMS = orphans.Parent("l1_geology_terms", "term_id")
KEYS = (
    orphans.ForeignKey("geotech_features", "feature_id", "geology_unit_card_id", CARDS, "built_at"),
    orphans.ForeignKey("l2_geology_to_geotech", "map_id", "source_ref", SOURCES, "updated_on"),
    orphans.ForeignKey("pdf_curated_labels", "line_no", "asset_id", ASSETS, "labelled_on"),
)


#: The cascade's graph: cards also refer to L1 terms (in their chain), and the terms to knowledge
#: sources, so that a lost source reaches the features through terms and cards.
def deeper_keys() -> tuple[orphans.ForeignKey, ...]:
    refs = F.regexp_extract_all(F.col("chain"), F.lit(r'"knowledge_ref\\*": \\*"terms :: (T\d+)'), F.lit(1))
    return (
        *KEYS,
        orphans.ForeignKey("inference_chains", "geology_unit_card_id", "chain", TERMS, "built_at", many=refs),
        orphans.ForeignKey("l1_geology_terms", "term_id", "source_ref", SOURCES),
    )


def orphan_tables(spark: SparkSession, d: str, keys: tuple[orphans.ForeignKey, ...]) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in {k.child for k in keys} | {k.parent.name for k in keys}}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The cascade over the whole graph, cut to the three references that are cases."""
    keys = deeper_keys()
    rows = orphans.found(orphan_tables(spark, d, keys), keys)
    return rows.where(F.col("table_name").isin(*[k.child for k in KEYS]))


def p5_orphan_report(spark: SparkSession, d: str) -> DataFrame:
    keys = deeper_keys()
    return orphans.report(orphans.cascade(orphan_tables(spark, d, keys), keys))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.links(table(spark, d, "inference_chains"), nested.CARDS)


def card_table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """A table of the cards with the given columns inlined from it (null where no card has them)."""
    own = nested.tables(table(spark, d, "inference_chains"), nested.CARDS, only=[name]).get(name)
    if own is None:
        own = spark.createDataFrame([], "geology_unit_card_id string, parent_table string, parent_id string, row_id string, parent_pos int, pos int")
    have = {c.lower() for c in own.columns}
    return own.select("geology_unit_card_id", *nested.FIXED, *[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns])


def p1_steps(spark: SparkSession, d: str) -> DataFrame:
    return card_table(spark, d, "chain", "step", "title_en", "confidence", "knowledge_ref", "inputs_raw_unit_name_ja", "inputs_detail_age", "outputs_engineering_ground_type", "outputs_mechanical_spt_n", "outputs_age_refined")


def p1_sources(spark: SparkSession, d: str) -> DataFrame:
    return card_table(spark, d, "sources", "id", "tier", "title", "url")


def p1_evidence(spark: SparkSession, d: str) -> DataFrame:
    return card_table(spark, d, "evidence", "value")


def p1_investigations(spark: SparkSession, d: str) -> DataFrame:
    return card_table(spark, d, "investigation", "value")


def p1_flags(spark: SparkSession, d: str) -> DataFrame:
    return card_table(spark, d, "risk_flags", "value")


def p1_figures(spark: SparkSession, d: str) -> DataFrame:
    return card_table(spark, d, "pdf_asset_ids", "value", "asset_id", "page")


def p1_vertices(spark: SparkSession, d: str) -> DataFrame:
    """A list in a list below another list: the vertices of all shapes, from their nested text."""
    shapes = table(spark, d, "geology_features").where("geom is not null").select("feature_id", F.to_json(F.struct(F.array(F.struct(F.col("geom").alias("rings"))).alias("parts"))).alias("shape"))
    own = nested.tables(shapes, nested.Nested(key="feature_id", columns=("shape",)), only=["rings_item"])["rings_item"]
    return own.select("feature_id", "parent_id", "row_id", "parent_pos", "pos", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    points = proximity.locations(table(spark, d, "query_points"), "query_id", "query.lat", "query.lon")
    sheets = proximity.rectangles(table(spark, d, "region_boundaries"), "region", "nominal_quadrangle")
    shapes = table(spark, d, "geology_features").select(F.col("feature_id").alias("shape_id"), F.col("geom").alias("rings"))
    near = proximity.near_pairs(points, 12.0)
    return (
        near.select(F.lit("near").alias("kind"), F.col("a").alias("query_id"), F.col("b").cast("string").alias("other_id"))
        .unionByName(proximity.in_rectangles(points, sheets).select(F.lit("sheet").alias("kind"), F.col("point_id").alias("query_id"), F.col("shape_id").alias("other_id")))
        .unionByName(proximity.in_shapes(points, shapes).select(F.lit("feature").alias("kind"), F.col("point_id").alias("query_id"), F.col("shape_id").alias("other_id")))
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.found(packed_fields(spark, d))


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    return packed.explode_values(packed_fields(spark, d))


def packed_fields(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, field_name, value) of the fields that hold several values."""
    fields = (
        ("geology_features", "feature_id", "raw_lithology"),
        ("l1_geology_terms", "term_id", "match_keywords_ja"),
        ("l2_geology_to_geotech", "map_id", "geotech_synonyms_ja"),
    )
    out = None
    for t, key, field in fields:
        part = table(spark, d, t).select(F.col(key).alias("record_id"), F.lit(field).alias("field_name"), F.col(field).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
