"""Knowledge tables: readers for files, and the default tables.

Every table can be replaced by a file of the same columns; what a step of the inference chain refers to is
named after the file it came from.  CSV and YAML files are small and read whole, from any file system
Spark knows; their order is kept as ``row_no``.

Defined results: rows whose id begins with ``#`` are left out, short rows are filled with nulls, a byte
order mark is skipped; a missing file is an error, a table that is not named is empty.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from importlib import resources
from typing import Any

from pyspark.sql import DataFrame, SparkSession

L1_COLUMNS = ("term_id", "priority", "match_on", "match_keywords_ja", "geological_material", "primary_lithology_ja", "primary_lithology_en", "grain_or_rock", "depositional_environment_ja", "depositional_environment_en", "typical_consolidation", "formation_group_ja", "stratigraphic_note_en", "source_ref")
#: What the eleven fields of a short row mean, where the table is to be repaired.
L1_REPAIRED = (*L1_COLUMNS[:9], "stratigraphic_note_en", "source_ref")
L2_COLUMNS = ("map_id", "priority", "match_geological_material", "match_grain_or_rock", "engineering_material_family", "engineering_ground_type", "geotech_term_ja", "geotech_term_en", "geotech_synonyms_ja", "rationale_en", "source_ref")
PROPERTIES = "ground_type string, summary_en string, mechanical map<string,string>, chemical map<string,string>, key_concerns_en array<string>, design_use boolean, source_ref string"
ADVICE = "ground_type string, applications map<string,string>, recommended_investigation array<string>, residual_uncertainty string"
SOURCES = "source_id string, title string, url string, tier string"
RISK = "ground_type string, flags array<string>"
RULES = "rule_id string, priority int, row_no int, keywords array<string>, fields array<string>, engineering_material_family string, engineering_ground_type string, risk_flags array<string>, confidence string, reason string"

#: Risk flags by ground type.
RISK_FLAGS = {
    "artificial_fill_reclaimed_ground": ("variable_fill", "settlement_screening", "liquefaction_screening", "contamination_screening", "unknown_fill_thickness"),
    "young_unconsolidated_soil": ("soft_compressible_soil", "settlement_screening", "shallow_groundwater", "organic_soil"),
    "alluvial_lowland_deposits": ("interbedded_variability", "settlement_screening", "shallow_groundwater", "liquefaction_screening"),
    "volcanic_ash_loam": ("moisture_sensitive", "high_void_ratio", "thickness_uncertainty", "slope_surface_erosion"),
    "terrace_deposits": ("abrupt_layer_change", "cobbles_boulders_possible", "perched_water_possible"),
    "pyroclastic_tuffaceous_ground": ("variable_strength", "weathering_degradation", "perched_water_possible", "slope_excavation_risk"),
    "weak_sedimentary_rock": ("slaking", "weathering_degradation", "variable_rockhead", "bedding_controlled_slope_excavation"),
    "hard_crystalline_rock": ("weathered_zone", "corestones_possible", "jointing_control", "variable_rockhead"),
    "fault_fracture_zone": ("high_uncertainty", "low_strength_zone", "groundwater_pathway", "slope_tunnel_risk"),
    "mixed_or_uncertain_geology": ("unclassified", "needs_manual_review"),
}


def read_whole(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0].removeprefix("\ufeff")


def csv_table(spark: SparkSession, text: str, columns: Sequence[str], short: Sequence[str] = ()) -> DataFrame:
    """The rows of a CSV text as strings, ``priority`` as a number, with their ``row_no``.  ``short``: the
    columns of rows that have just so many fields."""
    lines = [line for line in text.splitlines() if not line.startswith("#")]
    rows = []
    for cells in list(csv.reader(io.StringIO("\n".join(lines))))[1:]:
        if not cells:
            continue
        row = dict(zip(short if short and len(cells) == len(short) else columns, cells))
        rows.append((*[int(row[c]) if c == "priority" and row.get(c) else row.get(c) for c in columns], len(rows)))
    return spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c == 'priority' else 'string'}" for c in columns) + ", row_no int")


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], short: Sequence[str] = ()) -> DataFrame:
    return csv_table(spark, read_whole(spark, path), columns, short)


def own_text(name: str) -> str:
    return resources.files("lithoflow").joinpath("data", name).read_text("utf-8")


def default_l1(spark: SparkSession, repaired: bool = False) -> DataFrame:
    """The default terms.  Their rows are shorter than the header, so the last columns hold what stands
    there (a source's id for the consolidation); ``repaired`` puts the fields where they belong."""
    return csv_table(spark, own_text("l1_terms.csv"), L1_COLUMNS, L1_REPAIRED if repaired else ())


def default_l2(spark: SparkSession) -> DataFrame:
    return csv_table(spark, own_text("l2_map.csv"), L2_COLUMNS)


def risk_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, list(f)) for t, f in RISK_FLAGS.items()], RISK)


def read_yaml(spark: SparkSession, path: str) -> Any:
    import yaml

    return yaml.safe_load(read_whole(spark, path))


def texts(v: Any) -> dict[str, str]:
    """A mapping with its values as text."""
    return {str(k): x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, default=str) for k, x in (v or {}).items()}


def listed(v: Any) -> list[str]:
    return [str(x) for x in ([v] if isinstance(v, str) else v or [])]


def properties_table(spark: SparkSession, doc: Mapping[str, Any]) -> DataFrame:
    rows = [(str(k), p.get("summary_en", ""), texts(p.get("mechanical")), texts(p.get("chemical")), listed(p.get("key_concerns_en")), bool(p.get("design_use", False)), ";".join(listed(p.get("source_ref")))) for k, p in (doc.get("ground_types") or {}).items()]
    return spark.createDataFrame(rows, PROPERTIES)


def advice_table(spark: SparkSession, doc: Mapping[str, Any]) -> DataFrame:
    rows = [(str(k), texts(p.get("applications")), listed(p.get("recommended_investigation")), p.get("residual_uncertainty", "")) for k, p in (doc.get("ground_types") or {}).items()]
    return spark.createDataFrame(rows, ADVICE)


def sources_table(spark: SparkSession, doc: Mapping[str, Any]) -> DataFrame:
    rows = [(str(k), s.get("title"), s.get("url", ""), s.get("tier")) for k, s in (doc.get("sources") or {}).items()]
    return spark.createDataFrame(rows, SOURCES)


def rules_table(spark: SparkSession, doc: Mapping[str, Any]) -> DataFrame:
    """Keyword rules for ``rules.match_rules``, in file order."""
    rows = [
        (r["rule_id"], int(r.get("priority", 999)), k, listed(r.get("match_keywords_ja")) + listed(r.get("match_keywords_en")), listed(r.get("match_fields")), r.get("engineering_material_family"), r.get("engineering_ground_type"), listed(r.get("risk_flags")), r.get("interpretation_confidence_default"), r.get("interpretation_reason_template"))
        for k, r in enumerate(doc.get("rules") or [])
    ]
    return spark.createDataFrame(rows, RULES)


def risk_of_rules(rules: DataFrame) -> DataFrame:
    """(ground_type, flags): those of the first rule of each ground type, in file order."""
    from pyspark.sql import functions as F

    return rules.groupBy(F.col("engineering_ground_type").alias("ground_type")).agg(F.min_by("risk_flags", "row_no").alias("flags"))


def code_table(spark: SparkSession, doc: Mapping[str, Any], section: str) -> DataFrame:
    """A mapping of codes from a document, such as an ontology: (code, payload as JSON text)."""
    return spark.createDataFrame([(str(k), json.dumps(v, ensure_ascii=False, default=str)) for k, v in (doc.get(section) or {}).items()], "code string, payload string")


@dataclass(frozen=True)
class KnowledgeBase:
    """All tables that the inference chain looks up, and the names its steps refer to them by."""

    l1: DataFrame
    l2: DataFrame
    risk: DataFrame
    properties: DataFrame
    advice: DataFrame
    sources: DataFrame
    rules: DataFrame
    ontology: DataFrame
    risk_dictionary: DataFrame
    names: dict[str, str] = field(default_factory=dict)


def load(spark: SparkSession, files: Mapping[str, str] | None = None, repaired: bool = False) -> KnowledgeBase:
    """The knowledge base from files by role: ``l1``, ``l2`` (CSV), ``l3``, ``l4``, ``sources``, ``rules``,
    ``ontology``, ``risk_dictionary`` (YAML).  Without a file, L1, L2 and the risk flags are the default
    tables and the others are empty."""
    files = dict(files or {})
    unknown = set(files) - {"l1", "l2", "l3", "l4", "sources", "rules", "ontology", "risk_dictionary"}
    if unknown:
        raise ValueError(f"unknown knowledge files: {sorted(unknown)}")
    doc = {role: read_yaml(spark, path) or {} for role, path in files.items() if role not in ("l1", "l2")}
    of = lambda role: doc.get(role, {})
    rules = rules_table(spark, of("rules"))
    return KnowledgeBase(
        l1=read_csv(spark, files["l1"], L1_COLUMNS, L1_REPAIRED if repaired else ()) if "l1" in files else default_l1(spark, repaired),
        l2=read_csv(spark, files["l2"], L2_COLUMNS) if "l2" in files else default_l2(spark),
        risk=risk_of_rules(rules) if "rules" in files else risk_table(spark),
        properties=properties_table(spark, of("l3")),
        advice=advice_table(spark, of("l4")),
        sources=sources_table(spark, of("sources")),
        rules=rules,
        ontology=code_table(spark, of("ontology"), "classes"),
        risk_dictionary=code_table(spark, of("risk_dictionary"), "flags"),
        names={role: path.rstrip("/").rpartition("/")[2] for role, path in files.items()},
    )


def flatten_paths(doc: Any, path: str = "") -> list[tuple[str, str]]:
    """(dotted path, text) of every scalar of a document."""
    if isinstance(doc, dict):
        return [x for k, v in doc.items() for x in flatten_paths(v, f"{path}.{k}" if path else str(k))]
    return [] if doc is None or isinstance(doc, list) else [(path, str(doc))]
