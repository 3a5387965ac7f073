"""The queries of this subpackage and the SQL that some of them have."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("q_urls", "q_quality", "q_simhash", "q_mixing", "q_pieces", "q_warc", "q_substrings", "q_neighbours", "q_language", "q_html", "q_positions", "q_codes", "q_whitening")


def _modules():
    return [importlib.import_module(f"strandspark.llm.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in _modules() if m.SQL}
