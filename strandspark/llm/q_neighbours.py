"""Query of nearest neighbours; recall is measured against brute force in tests/llm/test_neighbours.py."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.llm.neighbours import nearest
from strandspark.runtime import ship, table

NAME = "op8_nearest_neighbours"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)
