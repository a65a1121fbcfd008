"""A stream of points joined to static boxes: stateless, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def in_boxes(stream: DataFrame, boxes: DataFrame) -> DataFrame:
    """stream (point_id, lat, lon, ...) -> one row per box (shape_id, lon_min, ...) that holds the point,
    edges included.  An equi-join on the cells of a grid: boxes are covered by cells of a size that suits
    them, and points are sent to the cells of each size there is."""
    cells, levels = box_cells(boxes)
    spots = stream.withColumn("_level", F.explode(F.array(*[F.lit(x).cast("int") for x in levels])))
    size = F.lit(CELL) * F.pow(F.lit(2.0), F.col("_level"))
    spots = spots.withColumns({"_i": F.floor(F.col("lon") / size).cast("long"), "_j": F.floor(F.col("lat") / size).cast("long")})
    inside = F.col("lon").between(F.col("lon_min"), F.col("lon_max")) & F.col("lat").between(F.col("lat_min"), F.col("lat_max"))
    return spots.join(cells, ["_level", "_i", "_j"]).where(inside).drop("_level", "_i", "_j")


#: Cells of the finest grid, in degrees; a box has at most 17 of its own size along a side.
CELL = 1 / 16


def box_cells(boxes: DataFrame) -> tuple[DataFrame, list[int]]:
    """(boxes with _level, _i, _j of each cell they touch, the levels there are)."""
    span = F.greatest(F.col("lon_max") - F.col("lon_min"), F.col("lat_max") - F.col("lat_min"))
    sized = boxes.withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(span / (16 * CELL), F.lit(1e-12))))).cast("int"))
    size = F.lit(CELL) * F.pow(F.lit(2.0), F.col("_level"))
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    sized = sized.where("lon_min <= lon_max and lat_min <= lat_max")
    cells = sized.withColumn("_i", F.explode(F.sequence(at("lon_min"), at("lon_max")))).withColumn("_j", F.explode(F.sequence(at("lat_min"), at("lat_max"))))
    return cells, sorted(r[0] for r in sized.select("_level").distinct().collect()) or [0]


def counts_per_window(stream: DataFrame, at: str, width: str, late: str, by: str = "shape_id") -> DataFrame:
    """Points per box and time window; what comes later than ``late`` is left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n"))


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, to parquet; restarts go on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
