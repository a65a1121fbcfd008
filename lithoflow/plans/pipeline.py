"""The batch build: source files to features, cards and chains, and the files written from them."""

from __future__ import annotations

import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoflow import knowledge
from lithoflow.config import Config
from lithoflow.functions import geometry as G
from lithoflow.operators import assets, boundaries, cards, inference, normalize
from lithoflow.session import ship
from lithoflow.sinks import files, reports
from lithoflow.sources import pdf, shapefile

log = logging.getLogger("lithoflow.build")
FEATURE_COLUMNS = ["feature_id", "source_region", "source_map_name", "source_file", "geometry_area_m2", "centroid_lon", "centroid_lat", "raw_unit_code", "raw_unit_name_ja", "raw_unit_name_en", "raw_lithology", "raw_age"]
GROUND_COLUMNS = ["engineering_material_family", "engineering_ground_type", "geotech_term_ja", "geotech_term_en", "interpretation_confidence", "needs_manual_review", "geology_unit_card_id"]
CARD_COLUMNS = ["geology_unit_card_id", "source_region", "raw_unit_code", "raw_unit_name_ja", "raw_unit_name_en", "raw_lithology", "raw_age", "engineering_material_family", "engineering_ground_type", "geotech_term_ja", "geotech_term_en", "overall_confidence", "needs_manual_review", "risk_flags", "chain", "source_evidence"]
FLAT_COLUMNS = ["geology_unit_card_id", "source_region", "raw_unit_code", "raw_unit_name_ja", "raw_unit_name_en", "raw_lithology", "raw_age", "engineering_ground_type", "geotech_term_ja", "overall_confidence", "risk_flags", "needs_manual_review", "geology_chain"]
REGION = r"([0-9]{5})"


def read_shapes(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    return shapefile.read_folder(spark, path, names)


def source_evidence() -> F.Column:
    """The raw attributes a card rests on, and its figures."""
    raw = ("raw_unit_code", "raw_unit_name_ja", "raw_unit_name_en", "raw_lithology", "raw_age", "source_region")
    return F.struct(F.struct(*raw).alias("raw_attributes"), F.col("pdf_asset_ids"))


def flat_cards(cards_: DataFrame) -> DataFrame:
    rows = cards_.withColumns({"risk_flags": F.array_join("risk_flags", ";"), "geology_chain": inference.chain_text(F.col("chain"))})
    return rows.select(*FLAT_COLUMNS)


def unit_cards(units: DataFrame, base: knowledge.KnowledgeBase, figures: DataFrame | None = None, most: int = 12) -> DataFrame:
    """Cards with all columns, from numbered units (see ``cards.cards``)."""
    done = inference.infer(units, base.l1, base.l2, base.risk, "row_no", map_order="row_no")
    done = inference.with_chain(done, base.properties, base.advice, base.sources, base.names)
    keys = [F.coalesce(units[c], F.lit("")) == done[k] for c, k in (("raw_unit_name_ja", "name"), ("raw_lithology", "litho"), ("raw_age", "age"))]
    out = units.join(done, keys).drop("name", "litho", "age")
    out = out.withColumnsRenamed({"family": "engineering_material_family", "ground_type": "engineering_ground_type"})
    out = out.withColumn("engineering_material_family", F.coalesce("engineering_material_family", F.lit("mixed_or_unknown")))
    if figures is None:
        out = out.withColumn("pdf_asset_ids", F.array().cast("array<string>"))
    else:
        out = cards.linked_assets(out, figures.select("source_region", "asset_id").distinct(), "asset_id", most)
    return out.withColumn("source_evidence", source_evidence())


def figure_tables(spark: SparkSession, conf: Config) -> dict[str, DataFrame]:
    """The figures of all PDF files with their curated labels, the state of their texts, and what could not be
    decoded; none of them reads a file that is not there."""
    region = F.regexp_extract("source_pdf", REGION, 1)
    docs = pdf.read_files(spark, conf.pdf)
    labels = knowledge.read_csv(spark, conf.labels, ("asset_id", "content_label", "caption")) if conf.labels else None
    figures = assets.asset_index(pdf.extract_pictures(docs), region)
    labels = spark.createDataFrame([], "asset_id string, content_label string, caption string, line_no long") if labels is None else labels.withColumnRenamed("row_no", "line_no")
    texts = pdf.extract_texts(docs)
    scans = texts.select(region.alias("source_region"), "source_pdf", "jbig2_scanned", "ccitt_scanned", F.lit("JBIG2/CCITT bi-level page scans not decoded offline; OCR/vision needed.").alias("note"))
    index = assets.text_index(texts).withColumn("source_region", region)
    return {"figures": assets.labelled(figures, labels), "pdf_texts": index, "pdf_scans": scans}


def plan(spark: SparkSession, conf: Config) -> dict[str, DataFrame]:
    """The frames of a build, nothing run yet but the counting of small tables."""
    ship(spark)
    base = knowledge.load(spark, conf.knowledge, conf.repaired)
    shapes = read_shapes(spark, conf.raw, [s.file for s in conf.sheets])
    units = normalize.normalize(shapes, normalize.sheet_table(spark, list(conf.sheets)))
    units = units.withColumn("position", F.format_string("%05d-%010d", "sheet_order", "shape_index"))
    centre = G.vertex_mean(F.col("rings"))
    features = units.withColumns({"geometry_area_m2": F.round(G.polygon_area_m2(F.col("rings")), 1), "centroid_lon": F.round(centre["lon"], 6), "centroid_lat": F.round(centre["lat"], 6)})
    pictures = figure_tables(spark, conf) if conf.pdf else {}
    own = cards.cards(features, "position", ["raw_unit_name_en", "raw_lithology", "raw_age"])
    carded = unit_cards(own, base, pictures.get("figures"), conf.assets_per_card)
    link = carded.withColumnRenamed("overall_confidence", "interpretation_confidence")
    geotech = cards.with_card(features, link, [*GROUND_COLUMNS, "risk_flags"])
    out = {"geology_features": features.select(*FEATURE_COLUMNS), "geotech_features": geotech.select(*FEATURE_COLUMNS, *GROUND_COLUMNS, F.to_json("risk_flags").alias("geotechnical_risk_flags"))}
    out["geology_layer"] = features.select("feature_id", "source_region", "raw_unit_code", "raw_unit_name_ja", "raw_unit_name_en", "raw_lithology", "raw_age", "geometry_area_m2", "rings")
    out["geotech_layer"] = geotech.select("feature_id", "source_region", "raw_unit_name_ja", *GROUND_COLUMNS, F.array_join("risk_flags", ";").alias("risk_flags"), "rings")
    out["geotech_all"] = geotech.select(*FEATURE_COLUMNS, "raw_lithology_en", "raw_age_en", "source_attribute_json", *GROUND_COLUMNS, F.to_json("risk_flags").alias("geotechnical_risk_flags"))
    out["cards"] = carded.select(*CARD_COLUMNS)
    out["flat_cards"] = flat_cards(out["cards"])
    out["manual_review"] = out["flat_cards"].where("needs_manual_review")
    names = spark.createDataFrame([(s.region, s.name_en, s.name_ja, s.year) for s in conf.sheets], "region string, map_name_en string, map_name_ja string, map_year int")
    out["boundaries"] = boundaries.compute(features).join(names, "region", "left")
    return out | pictures


def exchange(written: dict[str, DataFrame], out: str) -> None:
    """The exchange files, from the written tables, so nothing is computed twice."""
    for name in ("geology_features", "geotech_features"):
        files.write_csv_file(written[name], f"{out}/{name}.csv")
    files.write_csv_file(written["flat_cards"], f"{out}/geology_unit_cards.csv")
    files.write_csv_file(written["manual_review"], f"{out}/manual_review_required.csv")
    files.write_json_file(written["cards"], f"{out}/inference_chains.json", ("inputs", "outputs"))
    files.write_json_file(written["cards"], f"{out}/geology_unit_cards.json", ("inputs", "outputs"))
    files.write_sqlite(f"{out}/features.sqlite", {"geotech_features": written["geotech_all"], "geology_unit_cards": written["flat_cards"], "manual_review_required": written["manual_review"]})
    files.write_gpkg(f"{out}/features.gpkg", {"geology_features": written["geology_layer"], "geotech_features": written["geotech_layer"]})
    reports.write_boundaries(written["boundaries"], f"{out}/region_boundaries.yaml", f"{out}/boundaries.md")
    if "figures" in written:
        index = written["figures"].drop("content")
        files.write_csv_file(index, f"{out}/pdf_asset_index.csv")
        files.write_json_file(index, f"{out}/pdf_asset_index.json")
        files.write_csv_file(written["pdf_texts"], f"{out}/pdf_text_blocks.csv")
        files.write_csv_file(written["pdf_scans"], f"{out}/pdf_undecoded_scanned.csv")
        with open(f"{out}/pdf_assets_clustering_summary.md", "w", encoding="utf-8") as f:
            f.write(reports.clustering(written["figures"], written["pdf_texts"], written["pdf_scans"]))


def build(spark: SparkSession, conf: Config) -> dict[str, int]:
    """Write all tables as parquet, and the exchange files if wanted; rows per table."""
    counts = {}
    written = {}
    log.info("build of %d sheets", len(conf.sheets))
    for name, df in plan(spark, conf).items():
        df.write.mode("overwrite").parquet(f"{conf.out}/{name}")
        written[name] = spark.read.parquet(f"{conf.out}/{name}")
        counts[name] = written[name].count()
        log.info("%s: %d rows", name, counts[name])
    if conf.pictures and "figures" in written:
        counts["picture_files"] = assets.write_pictures(written["figures"], f"{conf.out}/pdf_assets").count()
    if conf.single_files:
        os.makedirs(conf.out, exist_ok=True)
        exchange(written, conf.out)
    log.info("done: %s", json.dumps(counts))
    return counts


def boundaries_of(spark: SparkSession, path: str | None, features: DataFrame) -> DataFrame:
    """The sheets' boundaries from a reviewed file, or computed from the features where there is none."""
    if path is None:
        return boundaries.compute(features)
    doc = knowledge.read_yaml(spark, path) or {}
    cols = ("lon_min", "lat_min", "lon_max", "lat_max")
    box = lambda r, k: tuple(float(r[k][c]) for c in cols) if r.get(k) else None
    rows = [(str(r["region"]), int(r.get("n_polygons") or 0), box(r, "actual_data_bbox"), box(r, "nominal_quadrangle")) for r in doc.get("regions") or []]
    kind = "struct<" + ",".join(f"{c}:double" for c in cols) + ">"
    return spark.createDataFrame(rows, f"region string, n_polygons int, actual_data_bbox {kind}, nominal_quadrangle {kind}")
