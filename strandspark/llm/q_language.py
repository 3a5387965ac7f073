"""Query of language identification; held-out accuracy is tested in tests/llm/test_language.py."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.llm.language import fit, predict
from strandspark.runtime import ship, table

NAME = "op9_language_id"
SQL = None
FOLDS = 5


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id has no fold: such a row is not held out, and not learned from."""
    ship(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "lang")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    docs = docs.withColumn("held_out", F.coalesce(fold == 0, F.lit(False)))
    return predict(docs, fit(docs, ~F.col("held_out")))
