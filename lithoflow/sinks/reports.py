"""Reports for people: the sheets' boundaries and the figures by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoflow.sinks.files import markdown


def write_boundaries(boundaries: DataFrame, yaml_path: str, md_path: str) -> None:
    """The boundaries as a YAML file to be reviewed (it can be read again), and as a table."""
    import yaml

    ordered = boundaries.orderBy("region")
    span = lambda c, k: F.format_string("%s–%s", F.col(f"{c}.{k}_min").cast("string"), F.col(f"{c}.{k}_max").cast("string"))
    with open(yaml_path, "w", encoding="utf-8") as f:
        f.write("meta:\n  review_required: true\nregions:\n")
        for r in ordered.toLocalIterator():
            row = r.asDict(recursive=True)
            q = row["nominal_quadrangle"]
            row["nominal_quadrangle"] = q and q | {"span_deg": {"lon": round(q["lon_max"] - q["lon_min"], 6), "lat": round(q["lat_max"] - q["lat_min"], 6)}}
            f.write("".join(f"  {line}\n" for line in yaml.safe_dump([row], allow_unicode=True, sort_keys=False).splitlines()))
    table = ordered.select("region", F.format_string("%s (%s)", "map_name_en", "map_name_ja").alias("map"), "n_polygons", *[span(c, k).alias(f"{n} {k}") for c, n in (("actual_data_bbox", "data"), ("nominal_quadrangle", "frame")) for k in ("lon", "lat")])
    with open(md_path, "w", encoding="utf-8") as f:
        f.write(markdown(table, "Sheets"))


def most_common(rows: DataFrame, column: str, first: str) -> DataFrame:
    """Counts of a column's values, most first; ties in the order they first appear by ``first``."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first")).orderBy(F.desc("n"), "first").select(column, "n")


def clustering(figures: DataFrame, texts: DataFrame, scans: DataFrame) -> str:
    """Figures by region and by guessed content, how many are labelled, the state of texts and scans."""
    n, done = figures.agg(F.count(F.lit(1)), F.count_if(F.col("label_status") == "ai_curated")).first()
    parts = [
        markdown(figures.groupBy("source_region").count().orderBy("source_region"), "Figures by region"),
        markdown(most_common(figures, "content_type_guess", "asset_id"), "By guessed content"),
        f"Labelled: {done} of {n}.\n",
        markdown(texts.select("source_region", "source_pdf", "pages_est", "chars", "text_quality", "readable").orderBy("source_pdf"), "Texts"),
        markdown(scans.select("source_region", "source_pdf", "jbig2_scanned", "ccitt_scanned", "note").orderBy("source_pdf"), "Scans not decoded"),
    ]
    return "\n".join(parts)
