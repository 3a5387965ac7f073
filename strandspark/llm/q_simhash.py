"""Query of SimHash near-duplicates; SQL has no XXH64 (see tests/llm/test_simhash.py)."""

from pyspark.sql import DataFrame, SparkSession

from strandspark.llm.simhash import near_duplicates
from strandspark.runtime import ship, table

NAME = "op3_simhash_dedup"
SQL = None
SHINGLE, DISTANCE = 3, 3


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=SHINGLE, distance=DISTANCE)
