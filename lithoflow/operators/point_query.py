"""Batches of points answered with sheet, feature, card and distance to the feature's edge.

Defined results: a point outside all shapes has found = false and a message that names the sheets it is
in; a feature without a card has an empty chain (null), and so has a card that does not exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoflow.functions import geometry as G
from lithoflow.operators import proximity


def first_shape(points: DataFrame, shapes: DataFrame, order: str) -> DataFrame:
    """(point_id, shape_id): of the shapes that hold a point, the first by ``order``, a column of
    shapes (shape_id, rings, order)."""
    hits = proximity.in_shapes(points, shapes.select("shape_id", "rings"))
    ranks = shapes.select("shape_id", order).dropDuplicates(["shape_id"])
    return hits.join(ranks, "shape_id").groupBy("point_id").agg(F.min_by("shape_id", F.struct(order, "shape_id")).alias("shape_id"))


def answer(points: DataFrame, boxes: DataFrame, features: DataFrame) -> DataFrame:
    """One row per point of (point_id, lat, lon): regions (text, ``;``-joined, in order), found, message,
    shape_id, distance_m and the attributes of features (shape_id, rings, shape_order, ...)."""
    attributes = [c for c in features.columns if c not in ("shape_id", "rings", "shape_order")]
    regions = proximity.in_rectangles(points, boxes).groupBy("point_id").agg(F.array_join(F.array_sort(F.collect_set("shape_id")), ";").alias("regions"))
    first = first_shape(points, features, "shape_order")
    # rings travel once, and only those of shapes that won a point; the points come to them by the shape
    winners = features.drop("shape_order").join(first.select("shape_id").distinct(), "shape_id", "left_semi").dropDuplicates(["shape_id"])
    hit = first.join(points, "point_id").join(winners, "shape_id")
    hit = hit.select("point_id", "shape_id", F.round(G.distance_to_boundary_m(F.col("lon"), F.col("lat"), F.col("rings")), 1).alias("distance_m"), *attributes)
    out = points.join(regions, "point_id", "left").join(hit, "point_id", "left")
    message = F.when(F.col("shape_id").isNotNull(), F.lit(None)).when(F.col("regions").isNotNull(), F.concat(F.lit("inside sheet "), F.col("regions"), F.lit(" but no polygon at point"))).otherwise("outside the mapped extent")
    return out.select("point_id", "lat", "lon", F.coalesce("regions", F.lit("")).alias("regions"), F.col("shape_id").isNotNull().alias("found"), message.alias("message"), "shape_id", "distance_m", *attributes)


def with_cards(answers: DataFrame, links: DataFrame, cards: DataFrame) -> DataFrame:
    """answers with the ground of their feature (links: shape_id, geology_unit_card_id, ...) and with what its
    card says (cards: geology_unit_card_id, chain, ...).  Of repeated links and cards one counts."""
    link = links.where("shape_id is not null").dropDuplicates(["shape_id"])
    card = cards.where("geology_unit_card_id is not null").dropDuplicates(["geology_unit_card_id"])
    return answers.join(link, "shape_id", "left").join(card, "geology_unit_card_id", "left")
