"""The frames behind the tabs of a viewer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoflow.functions.text import nonblank


def sheet_overview(boundaries: DataFrame) -> DataFrame:
    span = lambda a, b: F.format_string("%.3f–%.3f", a, b)
    q = F.col("nominal_quadrangle")
    return boundaries.select("region", "n_polygons", span(q["lon_min"], q["lon_max"]).alias("longitude"), span(q["lat_min"], q["lat_max"]).alias("latitude"))


def ground_layer(features: DataFrame, types: list[str] | None = None) -> DataFrame:
    return features.where(F.col("engineering_ground_type").isin(types)) if types else features


def ground_types(features: DataFrame) -> DataFrame:
    return features.where(nonblank("engineering_ground_type")).select("engineering_ground_type").distinct().orderBy("engineering_ground_type")


def type_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("engineering_ground_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "engineering_ground_type")


def codes_of(labels: DataFrame, lang: str, chosen: list[str]) -> DataFrame:
    """(code): the codes whose label in a language was chosen; labels: (code, lang, label)."""
    return labels.where((F.col("lang") == lang) & F.col("label").isin(chosen)).select("code").distinct()


def with_preview(assets: DataFrame) -> DataFrame:
    """Figures that can be shown."""
    return assets.where(F.coalesce(F.length("preview_png"), F.lit(0)) > 0)


#: The badge of each confidence, and of none.
BADGES, NO_BADGE = {"high": "🟢", "medium": "🟡", "low": "🟠", "very_low": "🔴"}, "⚪"


def badge(confidence: Column) -> Column:
    out = F.lit(NO_BADGE)
    for level, sign in BADGES.items():
        out = F.when(confidence == level, sign).otherwise(out)
    return out


def chain_rows(cards: DataFrame, lang: str = "en") -> DataFrame:
    """A row per step of each card, last layer first, with its title in a language and its badge."""
    from lithoflow.operators.inference import display_order

    rows = cards.select("geology_unit_card_id", F.posexplode(display_order(F.col("chain"))).alias("shown", "s"))
    return rows.select("geology_unit_card_id", "shown", "s.step", F.col(f"s.title_{lang}").alias("title"), badge(F.col("s.confidence")).alias("badge"), "s.knowledge_ref", "s.outputs", "s.evidence", F.transform("s.sources", lambda x: x["id"]).alias("source_ids"))


def unit_labels(cards: DataFrame) -> DataFrame:
    label = F.concat(F.col("source_region"), F.lit(" · "), F.col("raw_unit_name_ja"), F.lit(" ("), F.col("raw_unit_code"), F.lit(") → "), F.col("engineering_ground_type"))
    return cards.select("geology_unit_card_id", label.alias("label"))


def figures(assets: DataFrame, region: str | None = None, label: str | None = None, pattern: str | None = None, most: int = 30) -> DataFrame:
    """Figures for a page of a viewer (the limit is the page), by region, label or a pattern in it."""
    out = assets
    if region:
        out = out.where(F.col("source_region") == region)
    if label and label != "(all)":
        out = out.where(F.col("content_label") == label)
    if pattern:
        out = out.where(F.coalesce(F.col("content_label").rlike(f"(?i){pattern}"), F.lit(False)))
    caption = F.concat_ws(" — ", F.when(nonblank("content_label"), F.col("content_label")).otherwise(F.col("content_type_guess")), F.when(nonblank("caption"), F.col("caption")))
    return out.withColumn("shown_caption", caption).orderBy("asset_id").limit(most)


def label_choices(assets: DataFrame) -> DataFrame:
    return assets.sparkSession.createDataFrame([("(all)", 0)], "label string, n int").unionByName(assets.where(nonblank("content_label")).select(F.col("content_label").alias("label"), F.lit(1).alias("n")).distinct()).orderBy("n", "label").select("label")


def review_list(cards: DataFrame) -> DataFrame:
    return cards.where("needs_manual_review").orderBy("geology_unit_card_id")
