"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.plans import analysis_queries, assembly_queries, geometry_queries, library_queries, recognition_queries, sample_queries, search_queries, source_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (library_queries, text_queries, search_queries, geometry_queries, analysis_queries, assembly_queries, recognition_queries, source_queries, sample_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries.bm25_search(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
