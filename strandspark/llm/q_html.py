"""Query of HTML extraction; SQL cannot express it (see tests/llm/test_html.py)."""

from pyspark.sql import DataFrame, SparkSession

from strandspark.llm.html_text import extract
from strandspark.runtime import ship, table

NAME = "op10_html_text"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return extract(table(spark, sf_dir, "pages"))
