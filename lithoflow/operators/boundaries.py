"""Extents of sheets and the frames they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoflow.functions import geometry as G


def compute(features: DataFrame) -> DataFrame:
    """(region, n_polygons, actual_data_bbox, nominal_quadrangle) from (source_region, rings): one
    aggregate over the boxes of the shapes, none over their vertices."""
    cols = ("lon_min", "lat_min", "lon_max", "lat_max")
    boxes = features.where(F.size("rings") > 0).select(F.col("source_region").alias("region"), G.bbox(F.col("rings")).alias("b"))
    agg = [(F.min if k.endswith("min") else F.max)(f"b.{k}").alias(k) for k in cols]
    out = boxes.groupBy("region").agg(F.count(F.lit(1)).cast("int").alias("n_polygons"), *agg)
    box = F.struct(*[F.round(k, 6).alias(k) for k in cols])
    return out.select("region", "n_polygons", box.alias("actual_data_bbox"), G.snap_box(F.struct(*cols)).alias("nominal_quadrangle"))
