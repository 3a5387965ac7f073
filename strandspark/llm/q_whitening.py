"""Query of embedding whitening; eigenvectors are beyond SQL (see tests/llm/test_whitening.py)."""

from pyspark.sql import DataFrame, SparkSession

from strandspark.llm.whitening import whiten
from strandspark.runtime import ship, table

NAME = "op13_whitening"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return whiten(table(spark, sf_dir, "embeddings"))
