"""The queries outside the text subpackage, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lithoflow.plans import problem_sql, problems, reference_queries, reference_sql

FLAGSHIP = "inference_chain_flat"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (problems.p1_found, problems.p1_steps, problems.p1_sources, problems.p1_evidence, problems.p1_investigations, problems.p1_flags, problems.p1_figures, problems.p1_vertices, problems.p3_found, problems.p5_found, problems.p5_orphan_report, problems.p6_found, problems.p6_values)
    return {f.__name__: f for f in (*reference_queries.QUERIES, *own)}


def oracle_sql() -> dict[str, str]:
    return reference_sql.SQL | problem_sql.SQL
