"""Figures of documents: limits, copies, ranks, pages, guesses, labels.

Defined results: an unknown width or height does not shut a picture out; copies keep the first by
codec and position; ranks count from 0 per file, largest first; of several labels of an asset the
last line counts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithoflow.functions.text import text_quality

MIN_BYTES, MIN_SIDE, MOST = 6000, 150, 80


def content_guess(width: Column, height: Column, n_bytes: Column) -> Column:
    ratio = width / height
    return (
        F.when(F.coalesce(width, F.lit(0)) * F.coalesce(height, F.lit(0)) == 0, "unknown")
        .when(ratio >= 1.8, "wide_figure (map/cross-section/chart?)")
        .when(ratio <= 0.6, "portrait_figure (column/log?)")
        .when(ratio.between(0.8, 1.25) & (n_bytes > 40000), "photo (rock/outcrop/photomicrograph?)")
        .otherwise("graphic_or_photo")
    )


def large_enough(width: Column, height: Column, n_bytes: Column) -> Column:
    side = lambda c: c.isNull() | (c == 0) | (c >= MIN_SIDE)
    return (n_bytes >= MIN_BYTES) & side(width) & side(height)


def first_of_copies(rows: DataFrame, copy_key: list[str], order: list[Column]) -> DataFrame:
    """One row of each group of exact copies."""
    w = W.partitionBy(*copy_key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def ranked(rows: DataFrame, group: str, order: list[Column], most: int = MOST) -> DataFrame:
    """The ``most`` first rows of each group, with their rank from 0.  The limit is the feature: Spark
    cuts each partition to it before the shuffle, so a huge group never meets in one task."""
    w = W.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).withColumn("rank", F.col("rank") - 1)


def page_estimate(offset: Column, page_offsets: Column) -> Column:
    """The number of page marks up to the position, 1 at least."""
    return F.greatest(F.lit(1), F.size(F.filter(page_offsets, lambda o: o <= offset)))


def asset_index(found: DataFrame, region: Column) -> DataFrame:
    """From ``sources.pdf.extract_pictures``: one row per kept picture."""
    rows = found.withColumn("n_bytes", F.length("content")).where(large_enough(F.col("width_px"), F.col("height_px"), F.col("n_bytes")))
    rows = rows.withColumns({"hash": F.md5("content"), "page_estimate": page_estimate(F.col("offset"), F.col("page_offsets"))})
    kept = first_of_copies(rows.drop("page_offsets"), ["source_pdf", "hash"], [F.col("filter_rank"), F.col("offset")])
    top = ranked(kept, "source_pdf", [F.desc("n_bytes"), F.col("filter_rank"), F.col("offset")])
    return top.select(
        F.format_string("%s_fig_%03d", region, F.col("rank")).alias("asset_id"),
        region.alias("source_region"),
        "source_pdf",
        "page_estimate",
        F.when(F.col("filter") == "DCTDecode", "jpg").otherwise("jp2").alias("format"),
        F.col("filter").alias("encoding"),
        "width_px",
        "height_px",
        "n_bytes",
        content_guess(F.col("width_px"), F.col("height_px"), F.col("n_bytes")).alias("content_type_guess"),
        "hash",
        "content",
    )


def write_pictures(figures: DataFrame, folder: str) -> DataFrame:
    """Write each figure as a file below a folder that all executors see: (asset_id, file)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names = []
            for region, asset, ext, raw in zip(b["source_region"], b["asset_id"], b["format"], b["content"]):
                os.makedirs(f"{folder}/{region}", exist_ok=True)
                names.append(f"{region}/{asset}.{ext}")
                with open(f"{folder}/{names[-1]}.part", "wb") as f:
                    f.write(raw)
                os.replace(f"{folder}/{names[-1]}.part", f"{folder}/{names[-1]}")  # a task run again does no harm
            yield b[["asset_id"]].assign(file=names)

    return figures.select("source_region", "asset_id", "format", "content").mapInPandas(run, "asset_id string, file string")


def previews(figures: DataFrame, side: int = 1000) -> DataFrame:
    """figures with ``preview_png``: a picture of at most ``side`` pixels; null where it can't be made (no
    imaging library, a codec it lacks)."""
    @F.pandas_udf("binary")
    def shrink(raws: pd.Series) -> pd.Series:
        try:
            from PIL import Image
        except ImportError:
            return pd.Series([None] * len(raws))
        import io

        out = []
        for raw in raws:
            try:
                im = Image.open(io.BytesIO(raw))
                im.thumbnail((side, side))
                done = io.BytesIO()
                im.convert("RGB").save(done, "PNG")
                out.append(done.getvalue())
            except Exception:  # noqa: BLE001  (whatever the library can't read has no preview)
                out.append(None)
        return pd.Series(out)

    return figures.withColumn("preview_png", shrink("content"))


def preview_count(shown: DataFrame) -> DataFrame:
    return shown.agg(F.count_if(F.length("preview_png") > 0).alias("previews_png"))


def text_index(texts: DataFrame) -> DataFrame:
    """From ``sources.pdf.extract_texts``: size, quality, whether it can be read, the beginning."""
    q = text_quality(F.col("text"))
    return texts.select("source_pdf", "pages_est", F.length("text").alias("chars"), F.round(q, 3).alias("text_quality"), ((q >= 0.85) & (F.length("text") > 200)).alias("readable"), F.substring("text", 1, 800).alias("text_sample"))


def last_labels(labels: DataFrame) -> DataFrame:
    """The last line of each asset."""
    return labels.where("asset_id is not null").groupBy("asset_id").agg(F.max_by(F.struct("content_label", "caption"), "line_no").alias("l")).select("asset_id", "l.content_label", "l.caption")


def labelled(assets: DataFrame, labels: DataFrame) -> DataFrame:
    """Assets with their label, caption and label_status."""
    hit = last_labels(labels).withColumn("label_status", F.lit("ai_curated"))
    return assets.join(hit, "asset_id", "left").withColumns(
        {"content_label": F.coalesce("content_label", F.lit("")), "caption": F.coalesce("caption", F.lit("")), "label_status": F.coalesce("label_status", F.lit("pending_ai_or_manual"))}
    )
