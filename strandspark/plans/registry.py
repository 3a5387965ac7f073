"""All queries of the phasing engine, with the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandspark.plans import core_queries, file_queries, study_queries


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haplotype table of the suppliers' view whose contigs are tens of keys."""
    return core_queries.haplotype_table(spark, sf_dir, "t")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return core_queries.QUERIES | study_queries.QUERIES | file_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return core_queries.SQL | study_queries.SQL | file_queries.SQL
