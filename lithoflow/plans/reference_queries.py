"""One query for each operator outside the ten problems, over the whole tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoflow.config import Sheet
from lithoflow.functions import geometry as G
from lithoflow.functions.text import nonblank, text_quality
from lithoflow.operators import assets, boundaries, cards, inference, localise, normalize, point_query, proximity, rules
from lithoflow.session import table
from lithoflow.sources import pdf

c = F.col


def features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "geology_features")


def points(spark: SparkSession, d: str) -> DataFrame:
    return proximity.locations(table(spark, d, "query_points"), "query_id", "query.lat", "query.lon")


def shapes(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).select(c("feature_id").alias("shape_id"), c("geom").alias("rings"), c("feature_id").alias("shape_order"), "raw_unit_code", "geometry_area_m2")


def normalize_units(spark: SparkSession, d: str) -> DataFrame:
    """The features as rows of a shapefile, every sheet with the same field profile."""
    names = {"Symbol": "raw_unit_code", "MAJOR_CODE": "source_region", "LEGEND04": "raw_unit_name_ja", "LEGEND03": "raw_unit_name_en", "LEGEND05": "raw_lithology", "LEGEND01": "raw_age", "LEGEND02": "raw_unit_name_en"}
    own = features(spark, d)
    attributes = F.map_from_arrays(F.array(*[F.lit(k) for k in names]), F.array(*[c(v) for v in names.values()]))
    types = F.create_map(F.lit("MAJOR_CODE"), F.lit("N"))
    shapes = own.select("source_file", F.regexp_extract("feature_id", "([0-9]+)$", 1).cast("int").alias("shape_index"), c("geom").alias("rings"), F.lit("x").alias("crs"), attributes.alias("attributes"), types.alias("field_types"))
    profile = normalize.sheet_table(spark, [Sheet("", "", "", "", "gsj_1984")]).drop("source_region", "source_map_name", "sheet_file", "sheet_order")
    sheets = own.groupBy(c("source_file").alias("sheet_file")).agg(F.min("source_region").alias("source_region"), F.min("source_map_name").alias("source_map_name")).withColumn("sheet_order", F.lit(0)).crossJoin(F.broadcast(profile))  # one row
    done = normalize.normalize(shapes, sheets)
    return done.select("feature_id", "source_file", "raw_unit_code", "raw_unit_name_ja", "raw_unit_name_en", "raw_lithology", "raw_age", F.get_json_object("source_attribute_json", "$.LEGEND05").alias("legend")).distinct()


def rule_two_pass(spark: SparkSession, d: str) -> DataFrame:
    units = inference.units(features(spark, d)).select("name", "litho").distinct()
    return rules.match_terms(units, rules.keyword_rules(table(spark, d, "l1_geology_terms"))).drop("material", "grain")


def inferred(spark: SparkSession, d: str) -> DataFrame:
    return inference.infer(features(spark, d), table(spark, d, "l1_geology_terms"), table(spark, d, "l2_geology_to_geotech"), coarse_terms=c("grain") == "coarse", fine_terms=c("grain") == "fine")


def inference_chain_flat(spark: SparkSession, d: str) -> DataFrame:
    return inferred(spark, d).select("name", "litho", "age", "term_id", "keyword", "field", "material", "grain", "age_refined", "map_id", "family", "ground_type", "l1_confidence", "l2_confidence", "overall_confidence", "needs_manual_review")


def ground_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(properties, advice, risk) by ground type, made from the tables there are; some types lack them."""
    own = table(spark, d, "l2_geology_to_geotech").where("engineering_ground_type is not null")
    per = own.groupBy(c("engineering_ground_type").alias("ground_type")).agg(F.min("geotech_term_en").alias("en"), F.min("geotech_term_ja").alias("ja"), F.min(F.trim("source_ref")).alias("source_ref"), F.count(F.lit(1)).alias("n"))
    none = F.create_map().cast("map<string,string>")
    properties = per.where("ground_type < 's'").select("ground_type", c("en").alias("summary_en"), F.create_map(F.lit("n"), c("n").cast("string")).alias("mechanical"), none.alias("chemical"), F.array("ja").alias("key_concerns_en"), F.lit(False).alias("design_use"), F.concat_ws(";", "source_ref", F.lit("NOT_THERE")).alias("source_ref"))
    advice = per.where("ground_type > 'c'").select("ground_type", none.alias("applications"), F.array("en").alias("recommended_investigation"), c("ja").alias("residual_uncertainty"))
    flags = table(spark, d, "geotech_features").where("geotechnical_risk_flags like '[%' and engineering_ground_type is not null")
    flags = flags.select(c("engineering_ground_type").alias("ground_type"), F.explode(F.from_json("geotechnical_risk_flags", "array<string>")).alias("flag")).where("flag is not null").distinct()
    return properties, advice, flags.groupBy("ground_type").agg(F.array_sort(F.collect_list("flag")).alias("flags"))


def chained(spark: SparkSession, d: str) -> DataFrame:
    properties, advice, risk = ground_tables(spark, d)
    terms, l2 = table(spark, d, "l1_geology_terms"), table(spark, d, "l2_geology_to_geotech")
    done = inference.infer(features(spark, d), terms, l2, risk, coarse_terms=c("grain") == "coarse", fine_terms=c("grain") == "fine")
    return inference.with_chain(done, properties, advice, table(spark, d, "knowledge_sources"))


def chain_display_order(spark: SparkSession, d: str) -> DataFrame:
    return chained(spark, d).select("name", "litho", "age", inference.chain_text(inference.display_order(c("chain"))).alias("chain_text"))


def chain_steps(spark: SparkSession, d: str) -> DataFrame:
    """Every step of every unit's chain, with its evidence, sources and some of its inputs and outputs."""
    rows = chained(spark, d).select("name", "litho", "age", F.explode("chain").alias("s"))
    of = lambda k: F.array_join(F.transform("s.sources", lambda x: x[k]), ";")
    some = lambda part, *ks: F.coalesce(*[c(f"s.{part}")[k] for k in ks])
    return rows.select(
        "name", "litho", "age", "s.step", "s.knowledge_ref", "s.matched_keyword", "s.confidence", F.array_join("s.evidence", " | ").alias("evidence"), of("id").alias("source_ids"), of("tier").alias("source_tiers"),
        some("inputs", "consolidation", "engineering_ground_type", "raw_age").alias("given"), some("outputs", "typical_consolidation", "geotech_term_ja", "key_concerns_en", "residual_uncertainty").alias("got"), F.size("s.outputs").alias("n_outputs"),
    )


def unit_risk_flags(spark: SparkSession, d: str) -> DataFrame:
    return chained(spark, d).select("name", "litho", "age", "ground_type", F.array_join("risk_flags", ";").alias("risk_flags"))


def manual_review(spark: SparkSession, d: str) -> DataFrame:
    return inferred(spark, d).where("needs_manual_review").groupBy("ground_type", "overall_confidence").agg(F.count(F.lit(1)).alias("n_units"))


def wildcard_translate(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "l1_geology_terms").select(F.coalesce("geological_material", F.lit("")).alias("material"), F.coalesce("grain_or_rock", F.lit("")).alias("grain")).distinct().withColumn("fact", F.concat_ws("/", "material", "grain"))
    return rules.translate(facts, table(spark, d, "l2_geology_to_geotech"))


def worst_confidence(spark: SparkSession, d: str) -> DataFrame:
    other = F.when(c("needs_manual_review"), "low").otherwise("high")
    return table(spark, d, "geotech_features").select(F.coalesce("interpretation_confidence", F.lit("")).alias("confidence"), rules.worst(c("interpretation_confidence"), other).alias("overall")).groupBy("confidence", "overall").agg(F.count(F.lit(1)).alias("n"))


def risk_flags_exploded(spark: SparkSession, d: str) -> DataFrame:
    text = F.trim("geotechnical_risk_flags")
    flags = F.when(text.startswith("["), F.from_json("geotechnical_risk_flags", "array<string>")).otherwise(F.split(text, ";"))
    return table(spark, d, "geotech_features").select(F.explode(flags).alias("flag")).select(F.trim("flag").alias("flag")).where("flag <> ''").groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def source_refs_lookup(spark: SparkSession, d: str) -> DataFrame:
    return inference.source_refs(table(spark, d, "l2_geology_to_geotech").select("map_id", "source_ref").distinct(), "map_id", "source_ref", table(spark, d, "knowledge_sources")).drop("url")


def own_cards(spark: SparkSession, d: str) -> DataFrame:
    return cards.cards(features(spark, d), "feature_id", ["raw_lithology", "raw_age"])


def unit_cards(spark: SparkSession, d: str) -> DataFrame:
    return own_cards(spark, d).select("geology_unit_card_id", *cards.KEY, "raw_lithology", "raw_age", "first_seen", "n_features")


def feature_card_join(spark: SparkSession, d: str) -> DataFrame:
    return cards.with_card(features(spark, d), own_cards(spark, d), ["geology_unit_card_id"]).select("feature_id", "geology_unit_card_id").distinct()


def card_assets_top12(spark: SparkSession, d: str) -> DataFrame:
    regions = table(spark, d, "pdf_asset_index").where("source_region is not null").select("source_region").distinct()
    own = table(spark, d, "pdf_asset_index").select("source_region", "asset_id").distinct()
    return cards.linked_assets(regions, own, "asset_id").select("source_region", F.array_join("pdf_asset_ids", ";").alias("asset_ids"))


def region_for_point(spark: SparkSession, d: str) -> DataFrame:
    return proximity.in_rectangles(points(spark, d), proximity.rectangles(table(spark, d, "region_boundaries"), "region", "nominal_quadrangle")).select(c("point_id").alias("query_id"), c("shape_id").alias("region"))


def bbox_filter(spark: SparkSession, d: str) -> DataFrame:
    inside = proximity.in_rectangles(points(spark, d), proximity.rectangles(table(spark, d, "region_boundaries"), "region", "actual_data_bbox"))
    return inside.groupBy(c("shape_id").alias("region")).agg(F.count(F.lit(1)).alias("n_points"))


def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    return proximity.in_shapes(points(spark, d), shapes(spark, d).select("shape_id", "rings")).select(c("point_id").alias("query_id"), c("shape_id").alias("feature_id"))


def first_polygon(spark: SparkSession, d: str) -> DataFrame:
    return point_query.first_shape(points(spark, d), shapes(spark, d), "shape_order").select(c("point_id").alias("query_id"), c("shape_id").alias("feature_id"))


def points_batch_query(spark: SparkSession, d: str) -> DataFrame:
    boxes = proximity.rectangles(table(spark, d, "region_boundaries"), "region", "nominal_quadrangle")
    return point_query.answer(points(spark, d), boxes, shapes(spark, d)).select(c("point_id").alias("query_id"), "regions", "found", "message", c("shape_id").alias("feature_id"), F.round("distance_m", 0).alias("distance_m"), "raw_unit_code")


def points_card_query(spark: SparkSession, d: str) -> DataFrame:
    """The answers with the ground and the card of the feature."""
    boxes = proximity.rectangles(table(spark, d, "region_boundaries"), "region", "nominal_quadrangle")
    links = table(spark, d, "geotech_features").groupBy(c("feature_id").alias("shape_id")).agg(F.min(F.struct("engineering_ground_type", "geology_unit_card_id")).alias("l")).select("shape_id", "l.*")
    cards_ = table(spark, d, "inference_chains").groupBy("geology_unit_card_id").agg(F.min("overall_confidence").alias("card_confidence"), F.min(F.length("chain")).alias("chain_length"))
    got = point_query.with_cards(point_query.answer(points(spark, d), boxes, shapes(spark, d)), links, cards_)
    return got.select(c("point_id").alias("query_id"), "found", c("shape_id").alias("feature_id"), "engineering_ground_type", "geology_unit_card_id", "card_confidence", "chain_length")


def haversine(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select(c("point_id").alias("query_id"), F.round(G.haversine_m(c("lon"), c("lat"), F.lit(139.5), F.lit(35.5)), 2).alias("metres"))


def polygon_area(spark: SparkSession, d: str) -> DataFrame:
    own = features(spark, d).where(F.size("geom") > 0).select("feature_id", "geom")
    return own.select("feature_id", F.round(G.polygon_area_m2(c("geom")), 1).alias("area_m2")).distinct()


def vertex_centroid(spark: SparkSession, d: str) -> DataFrame:
    own = features(spark, d).where(F.size("geom") > 0).select("feature_id", G.vertex_mean(c("geom")).alias("m"), G.bbox(c("geom")).alias("b"))
    return own.select("feature_id", F.round(c("m.lon") + 1e-9, 6).alias("lon"), F.round(c("m.lat") + 1e-9, 6).alias("lat"), "b.lon_min", "b.lat_min", "b.lon_max", "b.lat_max").distinct()


def region_extents(spark: SparkSession, d: str) -> DataFrame:
    own = features(spark, d).select(F.coalesce("source_region", F.lit("")).alias("source_region"), c("geom").alias("rings"))
    box = lambda k, name: [c(f"{k}.{x}").alias(f"{name}_{x}") for x in ("lon_min", "lat_min", "lon_max", "lat_max")]
    return boundaries.compute(own).select("region", "n_polygons", *box("actual_data_bbox", "data"), *box("nominal_quadrangle", "frame"))


def snap_quad(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region_boundaries").where("actual_data_bbox is not null").select("region", G.snap_box(c("actual_data_bbox")).alias("s")).select("region", "s.*")


def sample_line(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "region_boundaries").where("nominal_quadrangle is not null").select("region", "nominal_quadrangle.*").drop("span_deg").distinct()
    rows = b.select("region", F.inline(G.sample_line(c("lat_min"), c("lon_min"), c("lat_max"), c("lon_max"), 5000.0)))
    return rows.select("region", "i", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def outer_hole_grouping(spark: SparkSession, d: str) -> DataFrame:
    own = features(spark, d).where(F.size("geom") > 0).select("feature_id", G.polygons(c("geom")).alias("p"))
    return own.select("feature_id", F.size("p").alias("n_polygons"), F.aggregate("p", F.lit(0), lambda a, x: a + F.size(x) - 1).alias("n_holes")).distinct()


def text_quality_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.round(text_quality(c("text")), 3).alias("quality"))


def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").where("text is not null").select(c("doc_id").cast("string").alias("source_pdf"), F.coalesce("page_no", F.lit(1)).alias("pages_est"), "text")
    return assets.text_index(texts)


def dedupe_first_by_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.md5("text").alias("hash"))
    return assets.first_of_copies(rows, ["hash"], [c("doc_id")])


def figure_rank_top80(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "pdf_asset_index").select("source_pdf", "asset_id", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes")).distinct()
    return assets.ranked(own, "source_pdf", [F.desc("n_bytes"), c("asset_id")])


def content_guess(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "pdf_asset_index")
    return own.select("asset_id", assets.content_guess(c("width_px"), c("height_px"), c("n_bytes")).alias("guess"), F.coalesce(assets.large_enough(c("width_px"), c("height_px"), c("n_bytes")), F.lit(False)).alias("kept"))


def page_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Line ends as page marks: the page of the first digit of a text."""
    own = table(spark, d, "documents").where("text is not null")
    lengths = F.transform(F.split("text", "\\n", -1), lambda x: F.length(x) + 1)
    ends = F.aggregate(lengths, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    marks = F.slice(ends, 2, F.greatest(F.lit(0), F.size(ends) - 2))  # the last part has no line end
    first = F.length(F.regexp_extract("text", "^([^0-9]*)", 1)) + 1
    return own.select("doc_id", assets.page_estimate(first, marks).alias("page"))


def marker_counts(spark: SparkSession, d: str) -> DataFrame:
    """Marks of pages and scans in the bytes of files made from the documents' numbers."""
    own = table(spark, d, "documents").where("doc_id is not null")
    body = F.concat(F.lit("%PDF "), F.repeat(F.lit("<< /Type /Page >> << /Type /Pages >> "), F.pmod("doc_id", F.lit(7)).cast("int")), F.repeat(F.lit("/JBIG2Decode "), F.pmod("doc_id", F.lit(5)).cast("int")), F.repeat(F.lit("/CCITTFault "), F.pmod("doc_id", F.lit(3)).cast("int")))
    files = own.select(c("doc_id").cast("string").alias("source_pdf"), F.encode(body, "UTF-8").alias("content"))
    return pdf.extract_texts(files).select("source_pdf", "pages_est", "jbig2_scanned", "ccitt_scanned", "text").distinct()


def curated_last_wins(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "pdf_asset_index").select("asset_id", "content_type_guess").distinct()
    return assets.labelled(own, table(spark, d, "pdf_curated_labels")).select("asset_id", "content_type_guess", "content_label", "caption", "label_status")


def count_by_region(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).groupBy(F.coalesce("source_region", F.lit("")).alias("region")).agg(F.count(F.lit(1)).alias("n"))


def most_common(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "pdf_asset_index").groupBy(F.coalesce("content_type_guess", F.lit("")).alias("content_type_guess")).agg(F.count(F.lit(1)).alias("n"), F.min("asset_id").alias("first_asset"))
    return own.orderBy(F.desc("n"), "first_asset")


def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "geotech_features").where(nonblank("engineering_ground_type")).groupBy("engineering_ground_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("needs_manual_review").alias("n_review"))


def labelled_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pdf_curated_labels").groupBy(F.coalesce("content_label", F.lit("")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_if(nonblank("caption")).alias("n_captions"))


def localise_codes(spark: SparkSession, d: str) -> DataFrame:
    l2 = table(spark, d, "l2_geology_to_geotech")
    one = l2.where("engineering_ground_type is not null").groupBy(c("engineering_ground_type").alias("code")).agg(F.min("geotech_term_ja").alias("ja"), F.min("geotech_term_en").alias("en"))
    labels = one.select("code", F.inline(F.array(F.struct(F.lit("ja").alias("lang"), c("ja").alias("label")), F.struct(F.lit("en").alias("lang"), c("en").alias("label"))))).where("label is not null")
    codes = table(spark, d, "geotech_features").select(c("engineering_ground_type").alias("code")).unionByName(table(spark, d, "geotech_features").select(c("engineering_material_family").alias("code"))).where(nonblank("code")).distinct()
    return localise.localise(codes, "code", labels, "ja")


def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def union_assets(spark: SparkSession, d: str) -> DataFrame:
    index = table(spark, d, "pdf_asset_index").select("asset_id", F.lit("index").alias("origin"))
    both = index.unionByName(table(spark, d, "pdf_curated_labels").select("asset_id", F.lit("label").alias("origin")))
    return both.where("asset_id is not null").groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("origin")), ";").alias("origins"))


def build_summary(spark: SparkSession, d: str) -> DataFrame:
    count = lambda t, n: table(spark, d, t).agg(F.count(F.lit(1)).alias(n))
    review = table(spark, d, "inference_chains").agg(F.count(F.lit(1)).alias("n_cards"), F.count_if("needs_manual_review").alias("n_review"))
    rows = [count("geology_features", "n").select(F.lit("features").alias("what"), "n"), review.select(F.lit("cards").alias("what"), c("n_cards").alias("n")), review.select(F.lit("review").alias("what"), c("n_review").alias("n")), count("pdf_asset_index", "n").select(F.lit("figures").alias("what"), "n")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


QUERIES = (
    normalize_units, rule_two_pass, inference_chain_flat, chain_display_order, manual_review, wildcard_translate, worst_confidence, chain_steps, unit_risk_flags, risk_flags_exploded, source_refs_lookup, unit_cards, feature_card_join, card_assets_top12,
    region_for_point, bbox_filter, point_in_polygon, first_polygon, points_batch_query, points_card_query, haversine, polygon_area, vertex_centroid, region_extents, snap_quad, sample_line, outer_hole_grouping,
    text_quality_scores, text_blocks, dedupe_first_by_hash, figure_rank_top80, content_guess, page_estimate, marker_counts, curated_last_wins, count_by_region, most_common, value_counts, labelled_count, localise_codes, json_props, union_assets, build_summary,
)
