"""Unit cards: one per distinct unit, numbered by first appearance, and joined back to the features.

The expensive work (inference) is done once per card.  Numbering needs a total order over the cards;
it is a range-partitioned rank: each partition numbers its own cards and adds what lies before it, so
no single task sees all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("source_region", "raw_unit_code", "raw_unit_name_ja")


def first_rows(features: DataFrame, order: str, keep: list[str], key: tuple[str, ...] = KEY) -> DataFrame:
    """One row per key (nulls as ''), with ``keep`` of the row that comes first by ``order``."""
    rows = features.select(*[F.coalesce(F.col(k), F.lit("")).alias(k) for k in key], F.col(order).alias("_order"), *keep)
    return rows.groupBy(*key).agg(F.min("_order").alias("first_seen"), F.min_by(F.struct(*keep), "_order").alias("_first"), F.count(F.lit(1)).alias("n_features")).select(*key, "first_seen", "_first.*", "n_features")


def numbered(rows: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """The rows with their position from 0 in the total order of ``order``.

    Range partitioning puts the order's ranges side by side; a window per partition numbers its rows,
    and the sizes of the partitions before it (one number each) are added."""
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    from lithoflow.session import cut

    ranged = cut(ranged)  # the partition number must not change between its two uses
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_part", (F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).alias("before")).na.fill(0)
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.coalesce("before", F.lit(0))).drop("_part", "_own", "before")


def card_id(region: Column, code: Column, seq: Column) -> Column:
    return F.format_string("UC2_%s_%s_%03d", region, F.when(code == "", "NA").otherwise(code), seq)


def cards(features: DataFrame, order: str, keep: list[str]) -> DataFrame:
    """first_rows, numbered, with their card id."""
    out = numbered(first_rows(features, order, keep), ["first_seen", *KEY])
    return out.withColumn("geology_unit_card_id", card_id(F.col("source_region"), F.col("raw_unit_code"), F.col("seq")))


def with_card(features: DataFrame, cards: DataFrame, columns: list[str]) -> DataFrame:
    """Each feature with columns of its card."""
    own = cards.select(*[F.col(k).alias(f"_{k}") for k in KEY], *columns)
    on = [F.coalesce(features[k], F.lit("")) == F.col(f"_{k}") for k in KEY]
    return features.join(own, on).drop(*[f"_{k}" for k in KEY])


def linked_assets(cards: DataFrame, assets: DataFrame, order: str, most: int = 12) -> DataFrame:
    """Cards with the ids of the first assets of their region, in order; the limit is the feature."""
    w = W.partitionBy("source_region").orderBy(order)
    top = assets.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).groupBy("source_region").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "asset_id"))), lambda x: x["asset_id"]).alias("pdf_asset_ids"))
    return cards.join(top, "source_region", "left").withColumn("pdf_asset_ids", F.coalesce("pdf_asset_ids", F.array().cast("array<string>")))
