"""Query of SentencePiece encoding; SQL cannot express it (see tests/llm/test_pieces.py)."""

from pyspark.sql import DataFrame, SparkSession

from strandspark.llm.pieces import piece_digests
from strandspark.runtime import ship, table

NAME = "op5_sentencepiece"
VOCABULARY = "piece_bpe_32k.model"
SQL = None


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return piece_digests(table(spark, sf_dir, "documents"), vocabulary())
