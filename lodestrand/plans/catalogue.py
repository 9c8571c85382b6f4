"""All core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrand.plans import assembly, building, evaluation, graphs, pairs, paths, projections, records, rules, scores, search, spanning, streams, texts

MODULES = [records, texts, graphs, scores, paths, search, evaluation, spanning, streams, building, rules, pairs, projections, assembly]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.SQL
    return out


FLAGSHIP = records.p3_found
