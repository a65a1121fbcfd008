"""Attribute maps of source files to the fixed columns of a unit, by the sheet's field profile.

Attributes are texts beside the type of their field (C text, N and F numbers, L truth value, ...; text where
no type is known).  Defined results: null, blank and, in fields of numbers and truth values, zero and
false count as missing; a text "0" is a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoflow.config import PROFILES, Sheet
from lithoflow.functions.text import strip
from lithoflow.operators.rules import small


def sheet_table(spark: SparkSession, sheets: list[Sheet]) -> DataFrame:
    """One row per sheet with its profile's fields as arrays; an unknown profile is an error."""
    rows = []
    for k, s in enumerate(sheets):
        p = PROFILES[s.profile]
        en = lambda names: [f"{n}E" for n in names]
        rows.append((s.region, f"{s.name_en} ({s.name_ja})", s.file, k, p["code"], p["name"], en(p["name"]), p["litho"], en(p["litho"]), p["age"], en(p["age"])))
    fields = ("code", "name", "name_e", "litho", "litho_e", "age", "age_e")
    return spark.createDataFrame(rows, "source_region string, source_map_name string, sheet_file string, sheet_order int, " + ", ".join(f"f_{f} array<string>" for f in fields))


def present(attributes: Column, types: Column) -> Column:
    """The attributes that are not missing, stripped: made once per row, whatever asks for them."""
    zero = lambda e: F.coalesce(F.try_element_at(types, e["key"]), F.lit("C")).isin("N", "F", "L") & e["value"].isin("0", "0.0", "-0.0", "false")
    stripped = F.transform(F.map_entries(attributes), lambda e: F.struct(e["key"].alias("key"), strip(e["value"]).alias("value")))
    return F.map_from_entries(F.filter(stripped, lambda e: F.coalesce(e["value"] != "", F.lit(False)) & ~zero(e)))


def values(present: Column, names: Column) -> Column:
    """The values of the named fields that are there."""
    return F.filter(F.transform(names, lambda n: F.try_element_at(present, n)), lambda v: v.isNotNull())


def first_value(present: Column, names: Column) -> Column:
    return F.coalesce(F.get(values(present, names), F.lit(0)), F.lit(""))


def joined(present: Column, names: Column) -> Column:
    return F.array_join(F.array_distinct(values(present, names)), " / ")


def json_text(c: Column) -> Column:
    """A text as JSON writes it."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


#: A text that JSON can hold as a number or truth value.
PLAIN_JSON = r"^(-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?|true|false)$"


def typed_json(attributes: Column, types: Column) -> Column:
    """The attributes as a JSON object in which numbers and truth values are such."""
    plain = lambda e: F.coalesce(F.try_element_at(types, e["key"]), F.lit("C")).isin("N", "F", "L")
    member = lambda e: F.concat(json_text(e["key"]), F.lit(":"), F.when(e["value"].isNull(), "null").when(plain(e) & e["value"].rlike(PLAIN_JSON), e["value"]).otherwise(json_text(e["value"])))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(attributes), member), ","), F.lit("}"))


def normalize(shapes: DataFrame, sheets: DataFrame) -> DataFrame:
    """Rows of the shapefile source joined to their sheet: ids, raw columns, attributes as JSON.
    Shapes without geometry are left out; the others keep their position in the file."""
    a, t = F.col("attributes"), F.coalesce("field_types", F.create_map().cast("map<string,string>"))
    rows = shapes.where(F.size("rings") > 0).join(small(sheets), F.col("source_file") == F.col("sheet_file"))
    return rows.withColumn("_present", present(a, t)).select(
        F.format_string("%s_A_%04d", "source_region", "shape_index").alias("feature_id"),
        "source_region", "source_map_name", "source_file", "sheet_order", "shape_index", "rings", "crs",
        first_value(F.col("_present"), F.col("f_code")).alias("raw_unit_code"),
        first_value(F.col("_present"), F.col("f_name")).alias("raw_unit_name_ja"),
        first_value(F.col("_present"), F.col("f_name_e")).alias("raw_unit_name_en"),
        joined(F.col("_present"), F.col("f_litho")).alias("raw_lithology"),
        joined(F.col("_present"), F.col("f_litho_e")).alias("raw_lithology_en"),
        joined(F.col("_present"), F.col("f_age")).alias("raw_age"),
        joined(F.col("_present"), F.col("f_age_e")).alias("raw_age_en"),
        typed_json(a, t).alias("source_attribute_json"),
    )
