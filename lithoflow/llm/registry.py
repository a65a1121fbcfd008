"""The queries of the text subpackage, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lithoflow.llm import queries as q
from lithoflow.llm import sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (q.p2_found, q.p2_restored, q.p4_found, q.p4_matched, q.p7_found, q.p7_forms, q.p7_stable, q.p8_packed, q.p8_fill, q.p8_placed, q.p9_mixed, q.p9_shares, q.p9_targets, q.p10_found, q.p10_scores, q.p10_sentences, q.p10_scored, q.p10_rates)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return sql.SQL
